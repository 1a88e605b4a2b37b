"""Column expressions. Everything here stays inside Catalyst; no Python runs per row."""
