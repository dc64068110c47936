"""waymark: Spark-first analytics over typed point features, and corpus operators."""
