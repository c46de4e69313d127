"""Operators over the tables of a block history."""
