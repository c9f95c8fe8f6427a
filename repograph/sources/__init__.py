"""Repograph sources."""
