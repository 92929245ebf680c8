"""Document analytics and retrieval as composable Spark DataFrame operators."""

__version__ = "0.1.0"
