"""Spark-first geospatial risk analytics."""
