"""Readers, writers and manifests."""
