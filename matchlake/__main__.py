import sys

from .plans.jobs import main

main(sys.argv[1:])
