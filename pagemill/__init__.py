"""pagemill: a Spark-native engine for collections of documentation pages."""

__version__ = "0.1.0"
