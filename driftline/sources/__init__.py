"""Readers, writers and views that turn stored tables into population relations."""
