"""A PySpark-native statistics and econometrics engine."""

__version__ = "0.1.0"
