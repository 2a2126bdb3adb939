"""Operators of tidemark."""
