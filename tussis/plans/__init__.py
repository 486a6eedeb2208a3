"""Registered queries and their SQL twins, one module per operator family."""
