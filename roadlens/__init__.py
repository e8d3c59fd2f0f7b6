"""Spark-first quality and traffic analytics over recorded road scenes."""
