"""plans of the definition-graph engine."""
