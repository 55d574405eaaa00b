"""Entity extraction from vector drawings, expressed as Spark DataFrame operations."""
