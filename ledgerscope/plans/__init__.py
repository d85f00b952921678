"""Operators bound to the standard tables, with the SQL that states the same result."""
