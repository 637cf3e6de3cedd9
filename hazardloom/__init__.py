"""hazardloom: a PySpark-native analytics engine for free-text safety reports."""

__version__ = "0.1.0"
