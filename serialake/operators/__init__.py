"""Relational operators: ``op(df, *, <column parameters>) -> DataFrame``."""
