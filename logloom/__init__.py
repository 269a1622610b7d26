"""Security-log analytics and knowledge graphs as Spark DataFrame operations."""
