"""Entity matching, ranking and data governance as plain PySpark DataFrame operators."""
