"""Keyspace analytics on PySpark."""
