"""Analytics over state graphs and text corpora, on Spark's DataFrame and SQL interfaces."""
