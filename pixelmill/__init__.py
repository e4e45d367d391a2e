"""Raster and frame-stream analytics written as Spark DataFrame plans."""
