"""Operators that prepare text for model training. Nothing else in docmill imports this package."""
