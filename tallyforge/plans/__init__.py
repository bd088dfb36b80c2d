"""Registered queries and checkpoints."""
