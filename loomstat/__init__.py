"""Analytics over samples-by-variables tables as Spark DataFrames."""
