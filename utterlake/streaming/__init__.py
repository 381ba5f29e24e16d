"""Structured Streaming forms of the operators; each gives the rows of its batch twin, however the input is cut."""
