"""Document retrieval, answer analytics and corpus preparation as Spark DataFrame operations."""
