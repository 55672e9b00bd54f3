"""vellum: code-integrity and training-data analytics expressed in Spark."""
