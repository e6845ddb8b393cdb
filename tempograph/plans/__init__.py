"""Whole queries: registry with SQL twins, and model evaluations."""
