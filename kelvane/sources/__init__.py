"""Inputs besides Parquet tables: line-delimited JSON, large objects, pages of results."""
