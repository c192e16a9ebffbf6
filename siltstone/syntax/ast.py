"""What the parser makes: types, terms, goals, statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from .diagnostics import Span

NOWHERE = Span()


@dataclass(frozen=True)
class Ty:
    """int, string, bool; option and list of an argument; named (an enum or an opaque kind); var (while inferring)."""

    kind: str
    arg: object = None

    def __str__(self) -> str:
        if self.kind in ("option", "list"):
            return f"{self.kind}<{self.arg}>"
        return str(self.arg) if self.kind == "named" else f"?{self.arg}" if self.kind == "var" else self.kind


INT, STRING, BOOL = Ty("int"), Ty("string"), Ty("bool")


def option(t: Ty) -> Ty:
    return Ty("option", t)


def list_of(t: Ty) -> Ty:
    return Ty("list", t)


def named(n: str) -> Ty:
    return Ty("named", n)


@dataclass(frozen=True)
class Term:
    span: Span = field(default=NOWHERE, compare=False, kw_only=True)


@dataclass(frozen=True)
class Var(Term):
    name: str


@dataclass(frozen=True)
class Wild(Term):
    pass


@dataclass(frozen=True)
class Lit(Term):
    """An int, string or bool."""

    value: object
    ty: Ty


@dataclass(frozen=True)
class Enum(Term):
    enum: str
    variant: str


@dataclass(frozen=True)
class NoneTerm(Term):
    ty: Ty | None = None


@dataclass(frozen=True)
class Some(Term):
    inner: Term


@dataclass(frozen=True)
class ListTerm(Term):
    items: tuple[Term, ...]
    ty: Ty | None = None


@dataclass(frozen=True)
class Expr:
    """term (a), neg (a), or + - * / (a, b)."""

    op: str
    a: object
    b: object = None
    span: Span = field(default=NOWHERE, compare=False)


@dataclass(frozen=True)
class Goal:
    span: Span = field(default=NOWHERE, compare=False, kw_only=True)


@dataclass(frozen=True)
class Atom(Goal):
    pred: str
    args: tuple[Term, ...]


@dataclass(frozen=True)
class Not(Goal):
    atom: Atom


@dataclass(frozen=True)
class Compare(Goal):
    """op: = != < <= > >="""

    op: str
    left: Term
    right: Term


@dataclass(frozen=True)
class Assign(Goal):
    var: str
    expr: Expr


@dataclass(frozen=True)
class Aggregate(Goal):
    """fn: count, count_distinct, sum, min, max; value: the projected variable, if any."""

    out: str
    fn: str
    value: str | None
    goals: tuple[Goal, ...]


@dataclass(frozen=True)
class TopK(Goal):
    tag: str
    k: Term
    group: Term
    score: str
    item: str
    goals: tuple[Goal, ...]


@dataclass(frozen=True)
class Disjunction(Goal):
    branches: tuple[tuple[Goal, ...], ...]


@dataclass(frozen=True)
class Include:
    path: str
    span: Span


@dataclass(frozen=True)
class EnumDecl:
    name: str
    variants: tuple[str, ...]
    span: Span


@dataclass(frozen=True)
class ModeDecl:
    pred: str
    args: tuple[tuple[str, Ty], ...]
    span: Span


@dataclass(frozen=True)
class Pragma:
    name: str
    value: int
    span: Span


@dataclass(frozen=True)
class PredDecl:
    name: str
    func: bool
    args: tuple[tuple[str, Ty], ...]
    attrs: frozenset[str]
    span: Span


@dataclass(frozen=True)
class Fact:
    atom: Atom
    span: Span


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Goal, ...]
    span: Span


@dataclass
class Program:
    """Statements in order; ``included``: for a file, the directives that led to it."""

    statements: list
    included: dict[str, tuple[Span, ...]] = field(default_factory=dict)


def term_vars(t: Term) -> set[str]:
    if isinstance(t, Var):
        return {t.name}
    if isinstance(t, Some):
        return term_vars(t.inner)
    if isinstance(t, ListTerm):
        return set().union(*map(term_vars, t.items))
    return set()


def has_wild(t: Term) -> bool:
    return isinstance(t, Wild) or isinstance(t, Some) and has_wild(t.inner) or isinstance(t, ListTerm) and any(map(has_wild, t.items))


def expr_vars(e: Expr) -> set[str]:
    if e.op == "term":
        return term_vars(e.a)
    return expr_vars(e.a) | (expr_vars(e.b) if e.b is not None else set())


def goal_vars(g: Goal) -> set[str]:
    """All variables that occur in a goal, nested goals and outputs included."""
    if isinstance(g, Atom):
        return set().union(*map(term_vars, g.args))
    if isinstance(g, Not):
        return goal_vars(g.atom)
    if isinstance(g, Compare):
        return term_vars(g.left) | term_vars(g.right)
    if isinstance(g, Assign):
        return {g.var} | expr_vars(g.expr)
    if isinstance(g, Aggregate):
        return {g.out} | goals_vars(g.goals)
    if isinstance(g, TopK):
        return {g.score, g.item} | term_vars(g.k) | term_vars(g.group) | goals_vars(g.goals)
    return set().union(*(goals_vars(b) for b in g.branches))


def goals_vars(goals) -> set[str]:
    return set().union(*map(goal_vars, goals))


def atoms_of(goals, sign: str = "positive"):
    """(atom, how) of all atoms in goals: positive, negative, aggregate or selection (the strongest on the way)."""
    for g in goals:
        if isinstance(g, Atom):
            yield g, sign
        elif isinstance(g, Not):
            yield g.atom, "negative" if sign == "positive" else sign
        elif isinstance(g, Aggregate):
            yield from atoms_of(g.goals, "aggregate")
        elif isinstance(g, TopK):
            yield from atoms_of(g.goals, "selection")
        elif isinstance(g, Disjunction):
            for b in g.branches:
                yield from atoms_of(b, sign)
