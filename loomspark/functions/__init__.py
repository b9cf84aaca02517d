"""Subpackage of loomspark."""
