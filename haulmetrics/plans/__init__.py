"""Pipelines that chain the operators, and the registry of named queries."""
