"""Readers, bridge views over the star tables, and writers."""
