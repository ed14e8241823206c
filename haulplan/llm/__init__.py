"""Operators of a training-data pipeline: one module per operator, plus the registered queries."""
