"""Typed tables in and out, and the corpus jobs that fill them."""
