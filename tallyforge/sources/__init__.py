"""Schemas, loaders and stored stages."""
