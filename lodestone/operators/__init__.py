"""Operators: SELECT, its join, predicates and aggregates; constraints, mutations and schema changes."""
