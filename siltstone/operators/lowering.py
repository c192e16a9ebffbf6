"""Goals to DataFrames.

A frame is a set of variable bindings: a DataFrame with a column ``v_X`` for each bound variable X, or no DataFrame for the one empty
binding.  A goal turns a frame into frames (a disjunction into several, whose variables may differ).  Everything
stays lazy but the checks of cardinality.  Errors of arithmetic and sizes of top-k are guarded in the plan itself (``Lowering.guarded``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import fmt, kind_of, known_type, merged, nullable, opaque, order_key, same, some, spark_type, unsome
from ..plans.resolve import BUILTINS, Predicate
from ..syntax import ast as A
from . import errors

I64_MIN = -(1 << 63)
#: Parts of a group whose best rows are found apart.
SALTS = 64
#: Pairs of two rows with equal keys from which they are made in tasks of about so many, and of a group in blocks of a quarter; most blocks a side and tasks.
PAIRS, SIDES, TASKS = 4_000_000, 64, 4096


@dataclass(frozen=True)
class Frame:
    df: DataFrame | None
    vars: tuple[str, ...] = ()

    def col(self, name: str) -> Column:
        return F.col(f"v_{name}")


@dataclass
class Context:
    """What goals need to know of a run."""

    spark: SparkSession
    predicates: dict[str, Predicate]
    enums: dict[str, tuple[str, ...]]
    relation: Callable[[str], DataFrame]  # columns c0, c1, ...
    keys: Callable[[str], DataFrame | None]  # (id, key) of an opaque kind
    default_key: Callable[[str, Column], Column]
    search: Callable[[DataFrame], DataFrame] | None = None  # requests (g, a, b) to (g, a, b, path)
    hops: Callable[[], DataFrame] | None = None
    note: Callable[[str], None] = lambda text: None
    serial: int = 0
    #: None: checks run at once, before what they guard; otherwise guards are part of plans, and what they look at is kept here.
    checks: list[DataFrame] | None = None

    def fresh(self) -> str:
        self.serial += 1
        return f"r{self.serial}"

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(True).alias("__unit"))


class Lowering:
    def __init__(self, ctx: Context, types: dict[str, A.Ty]):
        self.c, self.types = ctx, types

    # values
    def value(self, t: A.Term, ty: A.Ty) -> Column:
        """A ground term as a column."""
        if isinstance(t, A.Var):
            return F.col(f"v_{t.name}")
        if isinstance(t, A.Lit):
            return F.lit(t.value).cast(spark_type(t.ty, self.c.enums))
        if isinstance(t, A.Enum):
            return F.lit(t.variant)
        if isinstance(t, A.NoneTerm):
            return F.lit(None).cast(spark_type(ty, self.c.enums))
        if isinstance(t, A.Some):
            return some(self.value(t.inner, ty.arg), ty)
        if isinstance(t, A.ListTerm):
            return F.array(*(self.value(i, ty.arg) for i in t.items)).cast(spark_type(ty, self.c.enums))
        raise errors.RunError("DL0904", "a wildcard has no value")

    def type_of(self, t: A.Term, other: A.Term | None = None) -> A.Ty:
        return merged(known_type(t, self.types), known_type(other, self.types) if other is not None else None)

    def pattern(self, t: A.Term, col: Column, ty: A.Ty, bound: tuple[str, ...], new: dict[str, Column], keys: list, tests: list) -> None:
        """Matches a column with a term: variables it binds, equalities with bound ones, tests."""
        if isinstance(t, A.Wild):
            return
        if isinstance(t, A.Var):
            if t.name in new:
                tests.append(same(col, new[t.name], ty))
            elif t.name in bound:
                keys.append((col, t.name, ty))
            else:
                new[t.name] = col
        elif isinstance(t, (A.Lit, A.Enum)):
            tests.append(col == self.value(t, ty))
        elif isinstance(t, A.NoneTerm):
            tests.append(col.isNull())
        elif isinstance(t, A.Some):
            tests.append(col.isNotNull())
            self.pattern(t.inner, unsome(col, ty), ty.arg, bound, new, keys, tests)
        elif isinstance(t, A.ListTerm):
            tests.append(F.size(col) == len(t.items))
            for i, x in enumerate(t.items):
                self.pattern(x, F.get(col, i), ty.arg, bound, new, keys, tests)

    def guarded(self, df: DataFrame, found: Column) -> DataFrame:
        """``df``, whose evaluation fails if ``found`` (a marked error, or null) is not null in a row.

        The guard does not count as deterministic, so that no later filter is pushed below it and hides the row.
        """
        if self.c.checks is None:
            bad = df.select(found.alias("e")).where("e is not null").limit(1).collect()
            if bad:
                raise errors.from_spark(Exception(bad[0].e))
            return df
        self.c.checks.append(df.select(found.alias("e")).where("e is not null"))
        return df.where(F.when(found.isNotNull() & (F.rand(0) >= 0), F.raise_error(found).cast("boolean")).otherwise(F.lit(True)))

    def bind(self, f: Frame, t: A.Term, col: Column, ty: A.Ty) -> Frame:
        """Unifies a term with a column computed from the frame."""
        new: dict[str, Column] = {}
        keys: list = []
        tests: list = []
        self.pattern(t, col, ty, f.vars, new, keys, tests)
        return self.take(f, new, tests + [same(c, f.col(v), k) for c, v, k in keys])

    def take(self, f: Frame, new: dict[str, Column], tests: list) -> Frame:
        df = f.df if f.df is not None else self.c.unit()
        for x in tests:
            df = df.where(x)
        if new:
            df = df.select(*[f"v_{v}" for v in f.vars], *[c.alias(f"v_{v}") for v, c in new.items()])
        elif f.df is None and not tests:
            return f
        return Frame(df, (*f.vars, *new))

    def empty(self, f: Frame) -> Frame:
        return Frame((f.df if f.df is not None else self.c.unit()).where(F.lit(False)), f.vars)

    # goals
    def goals(self, frames: list[Frame], goals, modes=None) -> list[Frame]:
        for i, g in enumerate(goals):
            frames = [y for f in frames for y in self.goal(f, g, modes[i] if modes else None)]
        return frames

    def goal(self, f: Frame, g: A.Goal, mode) -> list[Frame]:
        if isinstance(g, A.Atom):
            return [self.builtin(f, g) if g.pred in BUILTINS else self.atom(f, g, mode)]
        if isinstance(g, A.Not):
            return [self.negation(f, g.atom)]
        if isinstance(g, A.Compare):
            return [self.compare(f, g)]
        if isinstance(g, A.Assign):
            return [self.assign(f, g)]
        if isinstance(g, A.Aggregate):
            return [self.aggregate(f, g)]
        if isinstance(g, A.TopK):
            return [self.topk(f, g)]
        return [y for b in g.branches for y in self.goals([f], b)]

    # atoms
    def scan(self, f: Frame, a: A.Atom, rel: DataFrame | None = None):
        """The relation with its tests applied: (DataFrame, columns of new variables, keys), all under fresh names."""
        p = self.c.predicates[a.pred]
        tag = self.c.fresh()
        df = rel if rel is not None else self.c.relation(a.pred)
        new: dict[str, Column] = {}
        keys: list = []
        tests: list = []
        for i, (t, ty) in enumerate(zip(a.args, p.types)):
            self.pattern(t, F.col(f"c{i}"), ty, f.vars, new, keys, tests)
        for x in tests:
            df = df.where(x)
        cols = [c.alias(f"{tag}_{v}") for v, c in new.items()] + [c.alias(f"{tag}_k{i}") for i, (c, _, _) in enumerate(keys)]
        df = df.select(*cols, *([] if cols else [F.lit(True).alias(f"{tag}_unit")]))
        on = [same(F.col(f"{tag}_k{i}"), f.col(v), ty) for i, (_, v, ty) in enumerate(keys)]
        return df, {v: f"{tag}_{v}" for v in new}, on

    def atom(self, f: Frame, a: A.Atom, mode, rel: DataFrame | None = None) -> Frame:
        p = self.c.predicates[a.pred]
        if p.func:
            self.exactly_one(f, a, p, mode)
        df, new, on = self.scan(f, a, rel)
        if f.df is None:
            if not new:
                return Frame(df.limit(1).select(F.lit(True).alias("__unit")))
            return Frame(df.select(*[F.col(c).alias(f"v_{v}") for v, c in new.items()]), tuple(new))
        keep = [F.col(f"v_{v}") for v in f.vars]
        if not new:
            if on:
                return Frame(f.df.join(df, _all(on), "left_semi"), f.vars)
            out = f.df.crossJoin(df.limit(1))
            return Frame(out.select(*keep) if keep else out.select("__unit"), f.vars)
        out = f.df.join(df, _all(on), "inner") if on else f.df.crossJoin(df)
        return Frame(out.select(*keep, *[F.col(c).alias(f"v_{v}") for v, c in new.items()]), (*f.vars, *new))

    def exactly_one(self, f: Frame, a: A.Atom, p: Predicate, mode) -> None:
        """Every evaluated input of a function must have one row: those of the mode, or else all ground arguments."""
        def is_ground(t):
            return not A.has_wild(t) and A.term_vars(t) <= set(f.vars)

        into = [i for i, t in enumerate(a.args) if (mode[i] if mode else is_ground(t))]
        every = self.c.relation(a.pred)
        rel = every.distinct()
        if not into:
            n = rel.count()
            if n != 1:
                raise errors.cardinality(p.name, n, "no inputs")
            return
        asked = f.df if f.df is not None else self.c.unit()
        asked = asked.select(*[self.value(a.args[i], p.types[i]).alias(f"a{i}") for i in into]).distinct()
        on = _all([same(F.col(f"a{i}"), F.col(f"c{i}"), p.types[i]) for i in into])
        # mostly every input has one row, repeats included; only where that is not so are whole rows told apart
        once = every.groupBy(*[F.col(f"c{i}") for i in into]).agg(F.count("*").alias("n")).where("n = 1")
        if asked.join(once, on, "left_anti").isEmpty():
            return
        found = rel.groupBy(*[F.col(f"c{i}") for i in into]).agg(F.count("*").alias("n"))
        bad = asked.join(found, on, "left").where(F.coalesce("n", F.lit(0)) != 1).select(F.coalesce("n", F.lit(0)).alias("n"), *[f"a{i}" for i in into]).limit(1).collect()
        if bad:
            shown = ", ".join(f"{p.names[i]}={bad[0][f'a{i}']!r}" for i in into)
            raise errors.cardinality(p.name, bad[0].n, f"inputs {shown}")

    def negation(self, f: Frame, a: A.Atom) -> Frame:
        if a.pred in ("witness_path", "path_hop"):
            hit = self.builtin(f, a)
            base = f.df if f.df is not None else self.c.unit()
            tag = self.c.fresh()
            other = hit.df.select(*[F.col(f"v_{v}").alias(f"{tag}_{v}") for v in f.vars]) if f.vars else hit.df.limit(1)
            on = _all([same(F.col(f"v_{v}"), F.col(f"{tag}_{v}"), self.types[v]) for v in f.vars]) if f.vars else F.lit(True)
            return Frame(base.join(other, on, "left_anti"), f.vars)
        if a.pred in BUILTINS:
            tests: list = []
            self.builtin(f, a, tests)
            return self.take(f, {}, [~F.coalesce(_all(tests), F.lit(False))])
        df, _, on = self.scan(f, a)
        base = f.df if f.df is not None else self.c.unit()
        return Frame(base.join(df if on else df.limit(1), _all(on) if on else F.lit(True), "left_anti"), f.vars)

    def builtin(self, f: Frame, a: A.Atom, tests: list | None = None) -> Frame:
        """A built-in predicate; with ``tests`` its condition goes there, for a negation."""
        types = self.c.predicates[a.pred].types
        val = [None if A.has_wild(t) or not A.term_vars(t) <= set(f.vars) else self.value(t, ty) for t, ty in zip(a.args, types)]
        if a.pred in ("contains", "starts_with"):
            cond = F.contains(val[0], val[1]) if a.pred == "contains" else F.startswith(val[0], val[1])
            if tests is not None:
                tests.append(cond)
                return f
            return self.take(f, {}, [cond])
        if a.pred in ("fmt", "coalesce"):
            out = fmt(val[0], val[1]) if a.pred == "fmt" else F.when(val[0].isNull(), val[1]).otherwise(unsome(val[0], types[0]))
            if tests is None:
                return self.bind(f, a.args[2], out, types[2])
            new: dict[str, Column] = {}
            keys: list = []
            own: list = []
            self.pattern(a.args[2], out, types[2], f.vars, new, keys, own)
            tests += own + [same(c, f.col(v), k) for c, v, k in keys] or [F.lit(True)]
            return f
        if a.pred == "witness_path":
            base = f.df if f.df is not None else self.c.unit()
            tag = self.c.fresh()
            base = base.select(*[f"v_{v}" for v in f.vars], *[v.alias(f"{tag}_{n}") for v, n in zip(val, "gab")])
            found = self.c.search(base.select(*[F.col(f"{tag}_{n}").alias(n) for n in "gab"]).distinct())
            found = found.select(*[F.col(n).alias(f"{tag}_f{n}") for n in "gab"], F.col("path").alias(f"{tag}_p"))
            on = _all([F.col(f"{tag}_{n}") == F.col(f"{tag}_f{n}") for n in "gab"])
            joined = base.join(found, on)
            g = self.bind(Frame(joined, f.vars), a.args[3], F.col(f"{tag}_p"), types[3])
            return Frame(g.df.select(*[f"v_{v}" for v in g.vars]) if g.vars else g.df.select(F.lit(True).alias("__unit")), g.vars)
        return self.atom(f, a, None, rel=self.c.hops())

    # constraints
    def keyed(self, f: Frame, col: Column, ty: A.Ty) -> tuple[Frame, Column]:
        """The order key of a column, with the host's keys joined where the type needs them."""
        if not opaque(ty, self.c.enums):
            return f, order_key(col, ty, self.c.enums)
        kind = kind_of(ty)
        while nullable(ty):
            col, ty = unsome(col, ty), ty.arg
        keys, default = self.c.keys(kind), self.c.default_key(kind, col)
        if keys is None:
            return f, default
        tag = self.c.fresh()
        base = f.df.withColumn(f"{tag}_id", col)
        keys = keys.select(F.col(keys.columns[0]).cast("long").alias(f"{tag}_kid"), F.col(keys.columns[1]).alias(f"{tag}_key"))
        lost = base.where(F.col(f"{tag}_id").isNotNull()).join(keys, F.col(f"{tag}_id") == F.col(f"{tag}_kid"), "left_anti")
        if not lost.isEmpty():
            self.c.note(f"some values of kind {kind} have no stable key; they are ordered by their ids")
        df = base.join(keys, F.col(f"{tag}_id") == F.col(f"{tag}_kid"), "left")
        return Frame(df, f.vars), F.coalesce(F.col(f"{tag}_key"), default)

    def compare(self, f: Frame, g: A.Compare) -> Frame:
        ty = self.type_of(g.left, g.right)
        is_ground = [not A.has_wild(t) and A.term_vars(t) <= set(f.vars) for t in (g.left, g.right)]
        if g.op == "=":
            if is_ground[1]:
                return self.bind(f, g.left, self.value(g.right, ty), ty)
            if is_ground[0]:
                return self.bind(f, g.right, self.value(g.left, ty), ty)
            return self.empty(f)
        if not all(is_ground):
            raise errors.RunError("DL0904", f"unbound variable in `{g.op}`")
        a, b = self.value(g.left, ty), self.value(g.right, ty)
        if g.op == "!=":
            return self.take(f, {}, [~same(a, b, ty)])
        if f.df is None:
            f = Frame(self.c.unit())
        if opaque(ty, self.c.enums):
            keep = [F.col(f"v_{v}") for v in f.vars]
            g1, ka = self.keyed(f, a, ty)
            g2, kb = self.keyed(g1, b, ty)
            if nullable(ty):
                ka, kb = F.struct(a.isNotNull().alias("has"), ka.alias("key")), F.struct(b.isNotNull().alias("has"), kb.alias("key"))
            return Frame(g2.df.where(_relation(g.op, ka, kb)).select(*keep), f.vars)
        return self.take(f, {}, [_relation(g.op, order_key(a, ty, self.c.enums), order_key(b, ty, self.c.enums))])

    def expression(self, e: A.Expr) -> tuple[Column, Column]:
        """(value, error code) of checked arithmetic; the value is null where there is an error."""
        none = F.lit(None).cast("string")
        overflow, division = errors.marked(errors.overflow()), errors.marked(errors.division())
        if e.op == "term":
            return self.value(e.a, A.INT), none
        a, err = self.expression(e.a)
        if e.op == "neg":
            return F.when(a != I64_MIN, F.try_subtract(F.lit(0).cast("long"), a)), F.coalesce(err, F.when(a == I64_MIN, overflow))
        b, err2 = self.expression(e.b)
        err = F.coalesce(err, err2)
        if e.op == "/":
            zero, over = b == 0, (a == I64_MIN) & (b == -1)
            safe = F.when(zero | over, None).otherwise(b).cast("long")
            whole = F.call_function("div", a, safe)
            return F.when(safe.isNotNull(), whole), F.coalesce(err, F.when(zero, division), F.when(over, overflow))
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b)
        return out, F.coalesce(err, F.when(a.isNotNull() & b.isNotNull() & out.isNull(), overflow))

    def assign(self, f: Frame, g: A.Assign) -> Frame:
        v, err = self.expression(g.expr)
        base = f.df if f.df is not None else self.c.unit()
        if g.expr.op != "term":
            base = self.guarded(base, err)
        return self.bind(Frame(base, f.vars), A.Var(g.var), v, A.INT)

    # aggregates and selection
    def inner(self, f: Frame, goals, also: set[str] = frozenset()) -> tuple[list[str], DataFrame | None, list[Frame]]:
        """Goals evaluated once for each distinct binding of the outer variables that they use."""
        used = A.goals_vars(goals) | set(also)
        captured = [v for v in f.vars if v in used]
        start = f.df.select(*[f"v_{v}" for v in captured]).distinct() if captured else None
        frames = self.goals([Frame(start, tuple(captured))], goals)
        return captured, start, frames

    def back(self, f: Frame, captured: list[str], got: DataFrame, outs: dict[str, str], how: str) -> Frame:
        """Joins results by captured variables to the frame; outputs overwrite."""
        tag = self.c.fresh()
        got = got.select(*[F.col(f"v_{v}").alias(f"{tag}_{v}") for v in captured], *[F.col(c).alias(f"{tag}_o{i}") for i, c in enumerate(outs.values())])
        base = f.df if f.df is not None else self.c.unit()
        on = [same(F.col(f"v_{v}"), F.col(f"{tag}_{v}"), self.types[v]) for v in captured]
        df = base.join(got, _all(on), how) if on else base.crossJoin(got)
        keep = [v for v in f.vars if v not in outs]
        return Frame(df.select(*[f"v_{v}" for v in keep], *[F.col(f"{tag}_o{i}").alias(f"v_{v}") for i, v in enumerate(outs)]), (*keep, *outs))

    def aggregate(self, f: Frame, g: A.Aggregate) -> Frame:
        captured, start, frames = self.inner(f, g.goals)
        by = [f"v_{v}" for v in captured]
        if g.value is not None:
            # a captured value counts once for each binding that has an answer
            frames = [x for x in frames if g.value in x.vars]
            parts = [x.df.select(*by, F.col(f"v_{g.value}").alias("x")) for x in frames]
            if not parts:
                return self.empty(Frame(f.df, (*f.vars,)))
            rows = _union(parts).distinct()
        else:
            groups: dict[tuple, list[DataFrame]] = {}
            for x in frames:
                names = tuple(sorted(x.vars))
                df = x.df if x.df is not None else self.c.unit()
                groups.setdefault(names, []).append(df.select(*[f"v_{v}" for v in names], *([] if names else ["__unit"])))
            parts = [_union(dfs).distinct().select(*by, F.lit(1).alias("x")) for dfs in groups.values()]
            rows = _union(parts)
        if g.fn in ("count", "count_distinct", "sum"):
            if g.fn == "sum":
                n = F.coalesce(F.sum(F.col("x").cast(T.DecimalType(38, 0))), F.lit(0))
            else:
                n = F.count("*")
            got = rows.groupBy(*by).agg(n.alias("n")) if by else rows.agg(n.alias("n"))
            if g.fn == "sum":
                wide = (F.col("n") > (1 << 63) - 1) | (F.col("n") < I64_MIN)
                got = self.guarded(got, F.when(wide, errors.marked(errors.overflow())))
            if by:
                tag = self.c.fresh()
                got = got.select(*[F.col(c).alias(f"{tag}_{c}") for c in by], "n")
                on = _all([same(F.col(c), F.col(f"{tag}_{c}"), self.types[v]) for c, v in zip(by, captured)])
                got = start.join(got, on, "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            else:
                got = got.select(F.col("n").cast("long").alias("n"))
            return self.back(f, captured, got, {g.out: "n"}, "inner")
        ty = self.types[g.value]
        h, key = self.keyed(Frame(rows, ()), F.col("x"), ty)
        if opaque(ty, self.c.enums) and nullable(ty):
            key = F.struct(F.col("x").isNotNull().alias("has"), key.alias("key"))
        rows = h.df.withColumn("__key", key)
        pick = (F.min if g.fn == "min" else F.max)(F.struct(F.col("__key").alias("k"), F.col("x").alias("x")))
        got = rows.groupBy(*by).agg(pick.alias("m")) if by else rows.agg(pick.alias("m")).where("m is not null")
        return self.back(f, captured, got.select(*by, F.col("m.x").alias("n")), {g.out: "n"}, "inner")

    def topk(self, f: Frame, g: A.TopK) -> Frame:
        fixed = isinstance(g.k, A.Lit)
        if fixed and g.k.value <= 0:
            raise errors.mismatch(f"choose_topk `{g.tag}` needs a positive number of rows, got {g.k.value}")
        if not fixed:
            k = self.value(g.k, A.INT)
            head, tail = errors.marked(errors.mismatch(f"choose_topk `{g.tag}` needs a positive number of rows, got |")).split("|")
            f = Frame(self.guarded(f.df, F.when(k.isNull() | (k <= 0), F.concat(F.lit(head), F.coalesce(k.cast("string"), F.lit("None")), F.lit(tail)))), f.vars)
        captured, _, frames = self.inner(f, g.goals, A.term_vars(g.k))
        by = [f"v_{v}" for v in captured]
        frames = [x for x in frames if {g.score, g.item} <= set(x.vars)]
        if not frames:
            return self.empty(f)
        rows = _union([x.df.select(*by, F.col(f"v_{g.score}").alias("s"), F.col(f"v_{g.item}").alias("i")) for x in frames]).distinct()
        ty = self.types[g.item]
        h, key = self.keyed(Frame(rows, ()), F.col("i"), ty)
        if opaque(ty, self.c.enums) and nullable(ty):
            key = F.struct(F.col("i").isNotNull().alias("has"), key.alias("key"))
        rows, order = h.df.withColumn("__key", key), [F.desc("s"), F.asc("__key")]
        if not by:  # a size that is no constant is captured, so this one is
            rows = rows.orderBy(*order).limit(g.k.value)
        elif fixed:
            rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= g.k.value)
        else:
            # sizes that are no constants cut no group before the shuffle; first the best of each of SALTS parts, so that no group meets in one task
            k = self.value(g.k, A.INT)
            for part in ([*by, "__part"], by):
                rows = rows.withColumn("__part", F.pmod(F.xxhash64("i"), F.lit(SALTS))).withColumn("__rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("__rn") <= k)
        return self.back(f, captured, rows.select(*by, "s", "i"), {g.score: "s", g.item: "i"}, "inner")

    # pairs
    def pairs(self, goals, a: A.Atom) -> Frame | None:
        """The bindings of a rule that pairs the rows of a relation by keys that its head drops, without repeated ones; None for other rules and for few pairs.

        What is paired through one key only is so once, so only what has several on both sides is looked at for repeats.  The square of a group is
        dealt out in blocks: memory of a task does not depend on the size of a group, and nothing of the pairs is shuffled or kept.
        """
        if len(goals) < 2 or not all(isinstance(g, A.Atom) for g in goals[:2]) or not all(isinstance(g, A.Compare) and g.op != "=" for g in goals[2:]):
            return None
        left, right = goals[:2]
        if left.pred != right.pred or left.pred in BUILTINS or self.c.predicates[left.pred].func or not all(isinstance(t, (A.Var, A.Wild)) for g in (left, right) for t in g.args):
            return None
        names = [[t.name for t in g.args if isinstance(t, A.Var)] for g in (left, right)]
        keys = [v for v in names[0] if v in names[1]]
        own = [[v for v in n if v not in keys] for n in names]
        shown = {t.name for t in a.args if isinstance(t, A.Var)}
        if any(len(set(n)) < len(n) for n in names) or not keys or not all(own) or shown != {*own[0], *own[1]} or any(A.goal_vars(g) & set(keys) for g in goals[2:]):
            return None
        if any(self.types[v].kind in ("option", "list") for v in keys):
            return None
        k = [f"v_{v}" for v in keys]
        sides = []
        for g, mine in zip((left, right), own):
            df = self.atom(Frame(None), g, None).df
            sides.append(([f"v_{v}" for v in mine], df.dropna(subset=k).distinct()))
        counts = [d.groupBy(*k).agg(F.count("*").cast("double").alias(f"n{i}")) for i, (_, d) in enumerate(sides)]
        size = counts[0].join(counts[1], k).agg(F.sum(F.col("n0") * F.col("n1")), F.max(F.col("n0") * F.col("n1"))).first()
        if (size[0] or 0) < PAIRS:
            return None
        cut, tasks = min(SIDES, int((4 * size[1] / PAIRS) ** 0.5) + 1), min(TASKS, int(size[0] / PAIRS) + 1)

        def dealt(df: DataFrame, mine: list[str], at: int) -> DataFrame:
            """Rows in every block that they are needed in; ``at``: 0 for the left side, 1 for the right."""
            whole = F.explode(F.sequence(F.lit(0), F.lit(cut - 1)))
            part = F.pmod(F.xxhash64(*mine), F.lit(cut)).cast("int")
            df = df.select(*mine, *k, part.alias(f"__{at}"), whole.alias(f"__{1 - at}"))
            return df.repartition(tasks, *k, "__0", "__1")

        parts = []
        for mine, d in sides:
            n = d.groupBy(*mine).agg(*[F.min(x).alias(x) for x in k], F.count("*").alias("__n"))
            tag = self.c.fresh()
            several = n.where("__n > 1").select(*[F.col(x).alias(f"{tag}_{x}") for x in mine])
            many = d.join(several, _all([F.col(x).eqNullSafe(F.col(f"{tag}_{x}")) for x in mine]), "left_semi")
            parts.append({"one": n.where("__n = 1").select(*mine, *k), "many": many})
        out = [*sides[0][0], *sides[1][0]]

        def met(x: str, y: str) -> DataFrame:
            return dealt(parts[0][x], sides[0][0], 0).join(dealt(parts[1][y], sides[1][0], 1).hint("merge"), [*k, "__0", "__1"]).select(*out)

        got = [met("one", "one")]
        if any(not p["many"].isEmpty() for p in parts):
            got += [met("one", "many"), met("many", "one"), met("many", "many").distinct()]
        f = Frame(_union(got), (*own[0], *own[1]))
        for g in goals[2:]:
            f = self.compare(f, g)
        return f

    # heads
    def head(self, frames: list[Frame], a: A.Atom, distinct: bool = False) -> DataFrame:
        """Rows of the head; ``distinct``: the frames have none twice."""
        p = self.c.predicates[a.pred]
        out = []
        for f in frames:
            df = f.df if f.df is not None else self.c.unit()
            cols = [self.value(t, ty).cast(spark_type(ty, self.c.enums)).alias(f"c{i}") for i, (t, ty) in enumerate(zip(a.args, p.types))]
            out.append(df.select(*cols) if cols else df.select(F.lit(True).alias("__unit")))
        return _union(out) if distinct else _union(out).distinct()


def _all(conds: list) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _relation(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

