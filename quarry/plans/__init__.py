"""Whole jobs: canonical tables, releases, token windows."""
