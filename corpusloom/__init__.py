"""corpusloom: analytics over web-document corpora, built on Spark DataFrames."""

__version__ = "0.1.0"
