"""A multi-model analytics engine on PySpark."""
