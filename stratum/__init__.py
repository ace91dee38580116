"""Corpus analytics and hybrid retrieval as Spark DataFrame operators."""
