"""Operators on texts and on matching records, for training data. Nothing outside imports this."""
