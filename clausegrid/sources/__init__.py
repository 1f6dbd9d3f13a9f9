"""Readers of documents and writers of reports."""
