"""Whole queries: from sources to documents, and the documents' forms."""
