"""navscore: judge the quality of intraday fund-value estimates with Spark DataFrames."""
