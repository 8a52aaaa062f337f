"""tessera: a Spark-native engine for cell-by-gene matrices and the evidence around them."""

__version__ = "0.1.0"
