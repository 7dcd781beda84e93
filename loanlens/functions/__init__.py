"""Column functions and fixed values."""

from loanlens.functions import constants, exprs

__all__ = ["constants", "exprs"]
