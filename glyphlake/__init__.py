"""Analytics over recognised document text, on Spark DataFrames."""
