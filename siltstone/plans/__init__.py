"""From statements to a plan: names, types, goal order, strata."""

from .compiler import Compiled, compile_program
from .resolve import Predicate

__all__ = ["Compiled", "Predicate", "compile_program"]
