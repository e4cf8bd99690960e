"""sources of the definition-graph engine."""
