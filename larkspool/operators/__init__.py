"""Operators over clip manifests."""
