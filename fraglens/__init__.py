"""fraglens: a PySpark-native analytics engine for single-cell genomics tables."""

__version__ = "0.1.0"
