"""marlstone: document-scanning and findings analytics on Spark DataFrames."""

__version__ = "0.1.0"
