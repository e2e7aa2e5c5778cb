"""Loomwright: documentation search and corpus preparation as Spark plans."""
