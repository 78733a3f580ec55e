"""shelfmark: content-based recommendation analytics expressed as Spark plans."""
