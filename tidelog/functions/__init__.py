"""Subpackage of the change-data journal engine."""
