"""Registered queries: an operator over rows that both engines derive alike, and its SQL."""
