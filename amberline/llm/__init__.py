"""Operators of a training-data pipeline over the text tables; nothing else in the library imports this."""
