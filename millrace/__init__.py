"""Analytics operators for PySpark, written for skewed data at cluster scale."""
