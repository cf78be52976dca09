"""finspark: checking of documents that contain numbers, on Spark DataFrames."""

__version__ = "0.1.0"
