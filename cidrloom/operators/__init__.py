"""Relational operators over layers and insert logs."""
