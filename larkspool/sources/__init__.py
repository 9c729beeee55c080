"""Readers and writers of manifests, codes, vectors and audio."""
