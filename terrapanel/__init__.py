"""terrapanel — territorial and time-series statistics on Spark DataFrames."""

__version__ = "0.1.0"
