"""Streaming surface."""
