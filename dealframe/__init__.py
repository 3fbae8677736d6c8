"""dealframe: Spark-first analytics for duplicate contract bridge."""

__version__ = "0.1.0"
