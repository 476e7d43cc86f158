"""Incremental maintenance of layers."""
