"""Rare-event classification on wide observation tables, as Spark jobs."""
