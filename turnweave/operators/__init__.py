"""Relational operators: ``(DataFrame, ..., parameters) -> DataFrame`` without actions inside."""
