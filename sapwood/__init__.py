"""Sapwood: path queries over tree-shaped documents, run as Spark plans."""
