"""Search, parsing and evaluation operators."""
