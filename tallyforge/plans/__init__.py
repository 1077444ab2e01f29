"""Parsed queries, their exact answers, estimates and evaluation."""
