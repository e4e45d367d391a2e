"""Stateful decisions over frame streams."""
