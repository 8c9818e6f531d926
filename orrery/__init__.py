"""Orrery: spatial corpus analytics as PySpark DataFrame operators."""
