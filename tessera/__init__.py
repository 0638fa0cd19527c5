"""Tessera: similarity search, ranking and analytics over text, audio and image collections on Spark DataFrames."""
