"""Operators for preparing training data: texts, embeddings, pages."""
