"""Lexarium: text-corpus preparation and retrieval as Spark plans."""
