"""functions of the journey engine."""
