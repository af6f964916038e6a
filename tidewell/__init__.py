"""Analytics over change-based sensor time series, written as Spark plans."""
