"""Spindrift: analytics over JSON documents and keyed JSON state streams, expressed in PySpark."""
