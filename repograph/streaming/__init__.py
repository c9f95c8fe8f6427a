"""Repograph streaming."""
