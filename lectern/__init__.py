"""Lectern: Spark jobs for corpora of cited texts."""
