"""A Spark engine for knowledge retrieval and catalog analytics."""
