"""Byte-plane analytics and lossless tensor compression on Spark DataFrames."""
