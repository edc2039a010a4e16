"""Semantic retrieval and analytics over collections of Markdown notes, as Spark DataFrame pipelines."""
