"""Density models in numpy and their use on executors."""
