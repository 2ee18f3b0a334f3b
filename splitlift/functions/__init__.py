"""Column expressions (native Spark, plus two small Arrow UDFs)."""
