"""Declarative rules, relational algebra and tuple-level provenance on Spark DataFrames."""
