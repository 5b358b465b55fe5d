"""Relational and time-ordered operators over readings."""
