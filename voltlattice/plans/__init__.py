"""Composite jobs: the public API of the library."""
