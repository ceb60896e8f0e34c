"""Example inputs derived from the test tables, and one query per operator."""
