"""Registered queries over rule corpora and their SQL."""
