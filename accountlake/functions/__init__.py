"""Column functions. Everything here stays inside Catalyst: no Python runs per row."""
