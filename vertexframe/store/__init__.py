"""Versioned stores of tables and object graphs."""
