"""Operators for preparing training text: one module per operator, `queries` registers them."""
