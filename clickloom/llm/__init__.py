"""Operators for preparing training text, each with one registered query ``opN_<name>``."""
