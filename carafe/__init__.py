"""Analytics over semi-structured menu text and training-data corpora, written for Spark."""
