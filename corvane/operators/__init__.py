"""Corvane subpackage."""
