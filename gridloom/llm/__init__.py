"""Operators of a training-data pipeline over document and page tables; nothing else in the library imports this."""
