"""Tessera: analytics over organisational knowledge, as PySpark DataFrame operators."""
