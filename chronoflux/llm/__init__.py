"""Operators that prepare text for model training, and their registered queries."""
