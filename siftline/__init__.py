"""Evidence retrieval, ranking and grounding analytics as PySpark operators."""
