"""Stateful operators on frame streams, and their batch twins."""
