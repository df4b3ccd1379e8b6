"""folioscope: a PySpark-native analytics engine for sequence corpora."""

__version__ = "0.1.0"
