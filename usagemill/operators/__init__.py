"""Relational operators over the canonical usage frame."""
