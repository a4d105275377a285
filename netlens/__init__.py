"""netlens: network-recording analytics over many sessions, expressed as Spark DataFrames."""

__version__ = "0.1.0"
