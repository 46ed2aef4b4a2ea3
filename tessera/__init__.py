"""Spark-first analytics for retrieval, knowledge graphs and memory lifecycles."""
