"""DataFrame operators of the menu engine."""
