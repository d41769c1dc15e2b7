"""DuckDB statements that say, independently of the Spark code, what each query must return."""
