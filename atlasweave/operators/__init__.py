"""operators of the definition-graph engine."""
