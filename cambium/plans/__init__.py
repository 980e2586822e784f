"""Composed analyses: final tables, the end-to-end run, registered queries."""
