"""Rasters and frame streams made of the relational tables, and Y4M files."""
