"""Timed-media analytics as Spark DataFrame jobs over many jobs (videos) at once."""
