"""Readers of messages and the store they are kept in."""
