"""Domain-name market statistics as PySpark DataFrame operators."""
