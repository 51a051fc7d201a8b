"""Software-composition analytics expressed as Spark DataFrame operations."""
