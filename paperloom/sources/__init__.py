"""Readers, writers, and the views that the bundled queries use."""
