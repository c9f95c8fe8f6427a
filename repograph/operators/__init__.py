"""Repograph operators."""
