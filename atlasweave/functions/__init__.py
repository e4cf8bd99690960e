"""functions of the definition-graph engine."""
