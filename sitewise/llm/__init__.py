"""Operators of a training-data pipeline over documents, pages, vectors and
conversations.  Nothing else in the package imports this subpackage."""
