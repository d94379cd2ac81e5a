"""Purchase-order data quality and evaluation as Spark jobs."""
