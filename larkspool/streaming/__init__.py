"""Streaming runs of the manifest operators."""
