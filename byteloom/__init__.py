"""Byte-stream analytics on PySpark."""
