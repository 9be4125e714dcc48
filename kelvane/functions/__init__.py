"""Column expressions whose semantics differ from Spark's defaults or that Spark lacks."""
