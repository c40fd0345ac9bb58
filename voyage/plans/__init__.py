"""plans of the journey engine."""
