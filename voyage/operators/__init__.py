"""operators of the journey engine."""
