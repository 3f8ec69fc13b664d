"""Narrative-arc analytics and text-data processing expressed as Spark plans."""
