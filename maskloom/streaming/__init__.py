"""Structured Streaming views of the decision log and of run events."""
