"""How results are shown: values, relations, and fragments in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Result
from .functions.values import order_key
from .plans import Compiled
from .syntax import ast as A


def text(v, ty: A.Ty, enums: dict) -> str:
    """A value as the language writes it; opaque values as kind#0xid."""
    if ty.kind == "option":
        if v is None:
            return "none"
        return f"some({text(v['some'] if ty.arg.kind == 'option' else v, ty.arg, enums)})"
    if ty.kind == "list":
        return "[" + ", ".join(text(x, ty.arg, enums) for x in v) + "]"
    if ty.kind == "bool":
        return "true" if v else "false"
    if ty.kind == "named" and ty.arg in enums:
        return f"{ty.arg}::{v}"
    if ty.kind == "named" and ty.arg != "Path":
        return f"{ty.arg}#0x{v & (1 << 64) - 1:016x}"
    if ty.kind == "int":
        return str(v)
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def show(result: Result, program: Compiled, only: list[str] = (), empty: bool = False, rows: int = 50) -> str:
    """Status, iterations, notes and relations; at most ``rows`` rows of each."""
    out = [f"status: {result.status}", f"iterations: {result.iterations}"]
    if result.notes:
        out += ["notes:", *[f"- [{s}] {m}" for s, m in result.notes]]
    out.append("relations:")
    for name in sorted(result.relations):
        if only and name not in only:
            continue
        df = result.relations[name]
        n = df.count()
        if not n and not empty:
            continue
        out.append(f"{name}: {n}")
        p = program.predicates.get(name)
        types = p.types if p else [A.STRING] * len(df.columns)
        shown = max(1, rows)
        for r in df.limit(shown).collect():
            out.append(f"  {name}({', '.join(text(v, t, program.enums) for v, t in zip(r, types))}).")
        if n > shown:
            out.append(f"  ... omitted {n - shown} row(s); use --max-rows to expand.")
    return "\n".join(out)


def fragments(df: DataFrame, program: Compiled, name: str) -> DataFrame:
    """Rows of a fragment relation by section, group, rank (highest first), sequence and kind."""
    p = program.predicates[name]
    place = {n.lower(): i for i, n in enumerate(p.names)}
    keys = [("section", True), ("group", True), ("rank", False), ("seq", True), ("kind", True)]
    order = [F.col(df.columns[place[k]]).asc() if up else F.col(df.columns[place[k]]).desc() for k, up in keys if k in place]
    rest = [order_key(F.col(c), t, program.enums) for i, (c, t) in enumerate(zip(df.columns, p.types)) if p.names[i].lower() not in dict(keys)]
    return df.orderBy(*order, *rest)
