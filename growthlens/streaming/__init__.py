"""Series counted from streams of events."""
