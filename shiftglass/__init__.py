"""Shiftglass: workplace-safety analytics as Spark jobs."""
