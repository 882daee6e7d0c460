"""meshflow: in-situ array analytics expressed with Spark DataFrames and Structured Streaming."""

__version__ = "0.1.0"
