"""Spatial-resolution analytics of large volumes as Spark jobs."""
