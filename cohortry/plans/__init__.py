"""Registered queries: one per operator, each with the SQL that checks it."""
