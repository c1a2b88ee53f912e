"""Analytics over large collections of short text records, on Spark DataFrames."""
