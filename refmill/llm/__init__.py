"""Operators for preparing training data from references and documents. Nothing else in refmill imports this."""
