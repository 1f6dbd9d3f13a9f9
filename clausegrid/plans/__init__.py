"""Whole plans: comparing two versions of documents, and the queries over the driver's tables."""
