"""linkloom: a PySpark-native engine for a web of pages linked by small badge images."""

__version__ = "0.1.0"
