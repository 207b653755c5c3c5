"""Operators of a training-data pipeline over text corpora; nothing else in the library imports this subpackage."""
