"""Column expressions shared by the jobs (native Spark expressions, one Arrow UDF)."""
