"""Operators that prepare text at training scale; nothing else in the package imports this."""
