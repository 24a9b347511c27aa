"""foliate: document and knowledge analytics as PySpark DataFrame operators."""
