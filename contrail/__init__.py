"""Analytics over large collections of grouped time series, as Spark DataFrame functions."""
