"""Column functions; all return plain :class:`pyspark.sql.Column`."""
