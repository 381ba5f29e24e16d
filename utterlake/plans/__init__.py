"""Registered queries of the library's operators."""
