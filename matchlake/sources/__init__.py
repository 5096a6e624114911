"""Readers and writers: JSON lines, text, CSV, versioned cells, dimensions, telemetry views."""
