"""Stateful operators and their batch twins."""
