"""Definitions and references in source code."""
