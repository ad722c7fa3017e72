"""Readers, sinks and the lift of relational tables onto gridded observations."""
