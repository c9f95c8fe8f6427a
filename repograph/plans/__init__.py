"""Repograph plans."""
