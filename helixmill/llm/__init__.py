"""Operators for preparing training text: nothing else in helixmill imports this subpackage."""
