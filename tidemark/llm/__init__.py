"""Operators of a training-data pipeline over text. Nothing outside imports this."""
