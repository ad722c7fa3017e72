"""Registered queries, each with its SQL oracle where SQL can express it."""
