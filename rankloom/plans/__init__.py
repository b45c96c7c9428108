"""Registered queries: operators bound to tables."""
