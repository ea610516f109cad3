"""Shared physical patterns (skew, timelines) and the query catalogue."""
