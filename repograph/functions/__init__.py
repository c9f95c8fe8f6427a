"""Repograph functions."""
