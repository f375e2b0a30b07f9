"""Operators on maps, pairs, manifests and records."""
