"""Spark operators for versioned script corpora, object catalogues and change sets."""
