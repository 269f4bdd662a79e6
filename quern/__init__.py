"""A retrieval, document-processing and training-data engine on Spark."""
