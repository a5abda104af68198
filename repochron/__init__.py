"""Repository-history analytics as Spark jobs."""
