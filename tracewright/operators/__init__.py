"""Trace operators."""
