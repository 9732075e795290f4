"""gridloom: gridded and site time series on Spark DataFrames."""
