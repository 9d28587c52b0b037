"""Governed analytics over document-derived facts, as PySpark DataFrame plans."""
