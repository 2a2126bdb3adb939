"""Functions of tidemark."""
