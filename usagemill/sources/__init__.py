"""Readers of usage logs, price tables, configuration and hook input."""
