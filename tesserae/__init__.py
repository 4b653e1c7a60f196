"""Evidence retrieval and training-data processing on Spark."""
