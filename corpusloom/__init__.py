"""corpusloom: a PySpark-native engine for crawled documents, crawl state and training text."""

__version__ = "0.1.0"
