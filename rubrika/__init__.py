"""Text categorization for Spark tables and streams."""
