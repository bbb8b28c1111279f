"""Operators over episodes, decisions, fingerprints, admissions and packs."""
