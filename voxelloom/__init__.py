"""Multi-view point-cloud analytics as PySpark DataFrame operators."""
