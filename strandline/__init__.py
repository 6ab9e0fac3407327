"""Transcript collections to features, chunks, a person/concept graph and vectors, as Spark plans."""
