"""Operators for preparing training data from documents, web pages, vectors and conversations."""
