"""platterlake: a Spark-native engine over archives of picture records."""

__version__ = "0.1.0"
