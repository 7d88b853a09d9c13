"""Reversible pseudonymization of text tables and streams on Spark."""
