"""Chiffra: traceable statistical reporting as Spark DataFrame plans."""
