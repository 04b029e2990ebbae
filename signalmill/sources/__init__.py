"""Readers that bring public records into one signal schema, and writers."""
