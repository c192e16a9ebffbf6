"""Coded messages with a place, a hint, and the includes that led there."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Span:
    """A stretch of a source: file, line and column from 1, offsets from 0."""

    file: str = "<input>"
    line: int = 1
    column: int = 1
    start: int = 0
    end: int = 0

    def to(self, other: Span) -> Span:
        return Span(self.file, self.line, self.column, self.start, max(self.end, other.end))

    def __str__(self) -> str:
        return f"{self.file}:{self.line}:{self.column}"


@dataclass
class Diagnostic:
    code: str
    message: str
    span: Span | None = None
    help: str | None = None
    includes: tuple[Span, ...] = ()

    def __str__(self) -> str:
        out = f"error[{self.code}]: {self.message}"
        if self.span:
            out += f"\n  --> {self.span}"
        if self.help:
            out += f"\n  help: {self.help}"
        return out + "".join(f"\n  included from {s}" for s in self.includes)


class CompileError(Exception):
    """All diagnostics of the stage that failed."""

    def __init__(self, stage: str, diagnostics: list[Diagnostic]):
        super().__init__("\n".join(map(str, diagnostics)))
        self.stage, self.diagnostics = stage, diagnostics

    @property
    def codes(self) -> list[str]:
        return [d.code for d in self.diagnostics]


@dataclass
class Bag:
    """Collects the diagnostics of a stage."""

    stage: str
    found: list[Diagnostic] = field(default_factory=list)

    def add(self, code: str, message: str, span: Span | None = None, help: str | None = None) -> None:
        self.found.append(Diagnostic(code, message, span, help))

    def check(self) -> None:
        if self.found:
            raise CompileError(self.stage, self.found)
