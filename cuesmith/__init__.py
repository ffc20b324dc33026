"""Spark jobs that prepare speech-transcript data."""
