"""How values of the language stand in Spark columns.

int: long; string; bool: boolean; enum: its variant's name; an opaque kind: a long id, Path: a string.  option<T> is a nullable T, and
a nullable struct where T itself can be null.  list<T> is an array.  All equality is null-safe where a null can stand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..syntax import ast as A


def nullable(t: A.Ty) -> bool:
    return t.kind == "option"


def boxed(t: A.Ty) -> bool:
    """Whether some(v) of this option type needs a struct around v."""
    return t.kind == "option" and nullable(t.arg)


def spark_type(t: A.Ty, enums: dict) -> T.DataType:
    if t.kind == "int":
        return T.LongType()
    if t.kind == "string":
        return T.StringType()
    if t.kind == "bool":
        return T.BooleanType()
    if t.kind == "option":
        inner = spark_type(t.arg, enums)
        return T.StructType([T.StructField("some", inner)]) if boxed(t) else inner
    if t.kind == "list":
        return T.ArrayType(spark_type(t.arg, enums))
    return T.StringType() if t.arg in enums or t.arg == "Path" else T.LongType()


def opaque(t: A.Ty, enums: dict) -> bool:
    """A host kind, alone or as an option: its order needs the host's keys."""
    return opaque(t.arg, enums) if t.kind == "option" else t.kind == "named" and t.arg not in enums and t.arg != "Path"


def kind_of(t: A.Ty) -> str:
    return kind_of(t.arg) if t.kind == "option" else t.arg


def same(a: Column, b: Column, t: A.Ty) -> Column:
    return a.eqNullSafe(b) if nullable(t) else a == b


def some(value: Column, t: A.Ty) -> Column:
    """some(value) of option type t."""
    return F.struct(value.alias("some")) if boxed(t) else value


def unsome(col: Column, t: A.Ty) -> Column:
    return col["some"] if boxed(t) else col


def order_key(col: Column, t: A.Ty, enums: dict) -> Column:
    """A column whose Spark order is the language's total order: enums by declaration, none before some, lists by element and then length."""
    if t.kind == "named" and t.arg in enums:
        return F.array_position(F.array(*map(F.lit, enums[t.arg])), col).cast("int")
    if t.kind == "option":
        inner = order_key(unsome(col, t), t.arg, enums)
        return F.struct(col.isNotNull().alias("has"), inner.alias("key"))
    if t.kind == "list" and t.arg.kind not in ("int", "string", "bool"):
        return F.transform(col, lambda x: order_key(x, t.arg, enums))
    return col


def known_type(t: A.Term, types: dict[str, A.Ty]) -> A.Ty | None:
    """The type of a term as far as it says itself; parts that it leaves open are None inside option and list."""
    if isinstance(t, A.Var):
        return types.get(t.name)
    if isinstance(t, A.Lit):
        return t.ty
    if isinstance(t, A.Enum):
        return A.named(t.enum)
    if isinstance(t, A.NoneTerm):
        return A.Ty("option", t.ty)
    if isinstance(t, A.Some):
        return A.Ty("option", known_type(t.inner, types))
    if isinstance(t, A.ListTerm):
        out = t.ty
        for i in t.items:
            out = merged(out, known_type(i, types))
        return A.Ty("list", out)
    return None


def merged(a: A.Ty | None, b: A.Ty | None) -> A.Ty | None:
    if a is None or b is None:
        return a or b
    return A.Ty(a.kind, merged(a.arg, b.arg)) if a.kind in ("option", "list") else a


def fmt(template: Column, args: Column) -> Column:
    """Successive {} replaced by args; those without an argument stay."""
    parts = F.split(template, r"\{\}", -1)
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < last, F.coalesce(F.get(args, i), F.lit("{}"))).otherwise(""))), "")
