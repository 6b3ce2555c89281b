"""Corpus graph analytics on Spark."""
