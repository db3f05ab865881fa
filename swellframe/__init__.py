"""Marine API request and payload analytics as PySpark DataFrame operations."""
