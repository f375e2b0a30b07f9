"""Dense-map evaluation and its data processing, as PySpark DataFrame operators."""
