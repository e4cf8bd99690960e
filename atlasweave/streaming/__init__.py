"""streaming of the definition-graph engine."""
