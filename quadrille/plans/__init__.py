"""Query plans and the registered queries."""
