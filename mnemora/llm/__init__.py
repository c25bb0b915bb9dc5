"""Operators that prepare training text: one module each, registered in ``queries``."""
