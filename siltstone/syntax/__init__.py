"""The language: tokens, grammar, and loading of files with their includes."""

from .ast import Program
from .diagnostics import CompileError, Diagnostic, Span
from .loader import load_program, load_text
from .parser import parse_program

__all__ = ["CompileError", "Diagnostic", "Program", "Span", "load_program", "load_text", "parse_program"]
