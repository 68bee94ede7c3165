"""Training-data operators for corpora; nothing else in the library imports this package."""
