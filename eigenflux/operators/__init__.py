"""Distributed operators on fields."""
