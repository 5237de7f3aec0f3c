"""Training-data operators: one module for each, and `registry` with their queries."""
