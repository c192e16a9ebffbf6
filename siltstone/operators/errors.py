"""Errors while a program runs: they end the run, which keeps what it has."""

from __future__ import annotations

import re


class RunError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message

    def __str__(self) -> str:
        return f"runtime error [{self.code}]: {self.message}"


def division() -> RunError:
    return RunError("DL0901", "division by zero")


def overflow() -> RunError:
    return RunError("DL0902", "integer overflow")


def mismatch(what: str) -> RunError:
    return RunError("DL0905", what)


def cardinality(pred: str, got: int, context: str) -> RunError:
    return RunError("DL0907", f"functional predicate `{pred}` cardinality violation: expected exactly 1 result, got {got} ({context})")


def extern_arity(pred: str, expected: int, got: int) -> RunError:
    return RunError("DL0908", f"extern relation `{pred}` has rows of arity {got}, expected {expected}")


def marked(e: RunError) -> str:
    """The error as a text that can be found again in an exception of Spark's."""
    return f"<{e.code}>{e.message}</>"


def from_spark(e: Exception) -> RunError | None:
    """What a guard in a plan has raised; as a backstop, Spark's own arithmetic errors."""
    text = str(e)
    if m := re.search(r"<(DL09\d\d)>([^<]*)</>", text):
        return RunError(m[1], m[2])
    if "DIVIDE_BY_ZERO" in text:
        return division()
    if "ARITHMETIC_OVERFLOW" in text or "CAST_OVERFLOW" in text or "NUMERIC_VALUE_OUT_OF_RANGE" in text:
        return overflow()
    return None
