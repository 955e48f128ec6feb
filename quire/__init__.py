"""Document processing and reading analytics on PySpark."""
