"""sources of the journey engine."""
