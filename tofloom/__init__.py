"""tofloom: a PySpark-native engine for event-mode pixel-detector data."""

__version__ = "0.1.0"
