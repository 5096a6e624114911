"""Block labeller: pages of the table, pages of other layouts, odd pages."""

import html
import re

import numpy as np
import pytest
from corpus import MIDDLE, table

from matchlake.llm import html_blocks


def article(page):
    """Main text by the table's own layout."""
    text = page[page.index("<article>") + 9 :]
    text = re.split("</article>|<footer", text)[0]
    text = re.sub(r"<br[^>]*>", " ", re.sub(r"</?(p|h\d)\b[^>]*>", "\x01", text))
    blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]*>", "", text).split("\x01"))
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def labeller(spark):
    return html_blocks.train(table(spark, "/root/testdata/sf0.1", "pages"))


def test_whole_table(spark):
    pages = table(spark, MIDDLE, "pages")
    sources = {r.page_id: r.html for r in pages.collect()}
    found = html_blocks.extracted(pages).collect()
    assert len(found) == len(sources)
    right = sum(r.text == article(sources[r.page_id]) and r.n_chars == len(r.text) for r in found)
    assert right / len(found) > 0.98


def test_other_layouts(labeller):
    page = """<html><head><title>News</title><style>p{}</style></head><body><div class="header"><a href="/">Home</a></div>
    <div class="cookie-notice">We use cookies.</div><div class="main-content"><h1>Big news today</h1>
    <p>The council met on Monday,\n and it agreed that the bridge will be built.</p><p>More than 300 people &amp; pets came.</p></div>
    <div id="comments"><p>I liked it, thanks a lot for this.</p></div><aside><p>Related: other things happened.</p></aside>
    <form>Email <input></form><script>var x = "<p>no</p>";</script><div class="footer">&copy; 2020 Site</div></body></html>"""
    expected = "Big news today\nThe council met on Monday, and it agreed that the bridge will be built.\nMore than 300 people & pets came."
    assert html_blocks.main_texts([page], labeller) == [expected]


def test_held_out_layouts(labeller):
    """Blocks of random layouts that were not trained on."""
    rng, right, whole = np.random.default_rng(99), 0, 0
    main = ["A title of words", "The first sentence stands here, as it should.", "Another sentence, with more words in it, ends here.", "Last one."]
    for _ in range(100):
        blocks, labels = html_blocks.relaid(main, ["Home", "About us", "Sign in", "Terms 2020"], ["I think so too, it was good.", "Never again, I say."], rng)
        chance = labeller.chances([html_blocks.features(blocks)])[0]
        right, whole = right + int(((chance >= 0.5) == labels).sum()), whole + len(labels)
    assert right / whole > 0.9


def test_gradients_are_right():
    """Backward steps agree with differences of the loss."""
    rng = np.random.default_rng(0)
    lstm = html_blocks.Lstm(rng, 5, 3)
    lstm.weights, lstm.bias = lstm.weights.astype(np.float64), lstm.bias.astype(np.float64)
    table_, alive = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float)
    change = rng.normal(size=(2, 4, 3)) * alive[:, :, None]
    loss = lambda: float((lstm.run(table_, alive)[0] * change).sum())
    _, tape = lstm.run(table_, alive, keep=True)
    gradient, _ = lstm.back(table_, tape, change)
    for at in [(0, 0), (3, 5), (6, 9), (7, 2)]:
        lstm.weights[at] += 1e-4
        above = loss()
        lstm.weights[at] -= 2e-4
        slope = (above - loss()) / 2e-4
        lstm.weights[at] += 1e-4
        assert gradient[at] == pytest.approx(slope, abs=1e-3)


def test_pieces_cover_long_pages():
    parts = html_blocks._pieces(np.zeros((7000, 1)))
    assert [use for _, _, use, _ in parts][0] == 0 and parts[-1][3] == 7000
    assert all(a[3] == b[2] for a, b in zip(parts, parts[1:], strict=False))
    assert all(last - first <= html_blocks.PIECE for first, last, _, _ in parts)


def test_odd_pages(spark, labeller):
    long = "<html><body><article>" + "<p>A sentence, in a long page, that goes on.</p>" * 6000 + "</article></body></html>"
    pages = [(1, "u", None), (2, None, ""), (3, "u", "  \n"), (None, "u", "<p"), (4, "u", "<<<>>>&&;&#xFFFFFFF;</p></div>"), (5, "u", long), (6, "u", "<script>x"), (6, "u", "<script>x")]
    frame = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    found = html_blocks.extracted(frame, labeller).collect()
    assert len(found) == len(pages) and all(r.n_chars == len(r.text) for r in found)
    assert all(r.text == "" for r in found if r.page_id in (1, 2, 3, 6))
    assert next(r for r in found if r.page_id == 5).text.count("\n") == 5999
    assert html_blocks.extracted(frame.where("page_id < 0")).collect() == []


def test_whole_blocks_and_names_are_read():
    same = "one two three four five six seven eight nine ten eleven twelve "
    words = slice(html_blocks.PATHS, html_blocks.PATHS + html_blocks.WORDS)
    rows = [html_blocks.features(html_blocks.blocks_of(f"<p>{same}{rest}</p>"))[0, words] for rest in ("read on below", "buy now and save")]
    assert np.abs(rows[0] - rows[1]).max() > 0.01 and rows[0].sum() == pytest.approx(1)
    page = f'<div class="{" ".join("abcdefghijkl")} sidebar"><p>Other things.</p></div>'
    assert ".sidebar" in html_blocks.blocks_of(page)[0].path
    formula = "<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, see <object data=\"a.pdf\">the paper</object>.</p>"
    assert html_blocks.blocks_of(formula)[0].text == "So x=1 holds, see the paper."


def test_long_pages_are_read_as_one(labeller, monkeypatch):
    """States pass from piece to piece: labels are those of the page read at once."""
    rng = np.random.default_rng(5)
    texts = ["Home", "A sentence, with words in it, that ends here.", "I liked it", "Terms 2020", "Then the council met, and it agreed.", "\xa9 Site"]
    page = "".join(f"<{tag}>{texts[rng.integers(6)]}</{tag}>" for tag in rng.choice(["p", "div", "li", "h2"], 5000))
    page = f'<div class="comments"><h3>Comments</h3>{page}</div>'
    blocks = html_blocks.blocks_of(page)
    whole = labeller.chances([html_blocks.features(blocks)])[0]
    assert len(blocks) > 2 * html_blocks.PIECE
    assert labeller.long_chances(blocks) == pytest.approx(whole, abs=1e-4)
    expected = html_blocks.main_texts([page, None, "<p>x</p>"], labeller)
    for piece in (7, 6000):
        monkeypatch.setattr(html_blocks, "PIECE", piece)
        assert html_blocks.main_texts([page, None, "<p>x</p>"], labeller) == expected
    # What stands at the far end of the page reaches the other one.
    monkeypatch.setattr(html_blocks, "PIECE", 16)
    slow = html_blocks.Labeller()
    for side in slow.sides:
        side.bias[html_blocks.WIDTH : 2 * html_blocks.WIDTH] = 20
    changed = html_blocks.blocks_of("<nav>Menu</nav>" + page[: len("<div class='comments'><h3>Comments</h3>")] + "<p>x</p>" * 300)
    plain = html_blocks.blocks_of("<article>A long sentence, in words.</article>" + page[: len("<div class='comments'><h3>Comments</h3>")] + "<p>x</p>" * 300)
    assert abs(slow.long_chances(changed)[-1] - slow.long_chances(plain)[-1]) > 1e-6
