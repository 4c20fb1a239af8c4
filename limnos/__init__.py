"""limnos: monitoring-data cleaning and integration on Spark DataFrames."""

__version__ = "0.1.0"
