"""Operators that prepare text and pages for training language models."""
