"""Interpretable models fitted with DataFrame operations."""
