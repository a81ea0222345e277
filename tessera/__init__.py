"""Vector retrieval, usage analytics and corpus preparation on PySpark."""
