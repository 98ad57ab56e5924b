"""Operators of a training-data pipeline over document and embedding tables. Nothing else in the library imports this subpackage."""
