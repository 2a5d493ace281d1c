"""docloom: document analytics as Spark DataFrame operations."""
