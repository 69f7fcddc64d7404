"""Readers for landed tables and files."""

from loamworks.sources.tables import table

__all__ = ["table"]
