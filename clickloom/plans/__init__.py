"""Composed jobs: the full report and the registered queries."""
