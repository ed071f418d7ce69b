"""Structured Streaming forms of the stateful folds."""
