"""Diagnostics of names, types, modes, safety and strata."""

import pytest

from siltstone.plans import compile_program
from siltstone.syntax import CompileError, parse_program


def compiled(source):
    return compile_program(parse_program(source))


@pytest.mark.parametrize(
    "source, code",
    [
        (".decl p(X: int). p(X).", "DL0402"),
        (".decl p(X: int). p(_).", "DL0402"),
        ("p(none).", "DL0201"),
        ("p([]).", "DL0202"),
        ("p(X) :- q(X).", "DL0100"),
        (".decl p(X: int). .decl p(X: int).", "DL0101"),
        (".type E = {A}. .type E = {B}.", "DL0102"),
        (".mode nope(+int).", "DL0103"),
        (".type E = {A}. p(E::B).", "DL0104"),
        ("p(F::B).", "DL0104"),
        (".decl p(X: int). p(\"a\").", "DL0200"),
        (".decl p(X: int). .mode p(+int, -int).", "DL0204"),
        (".decl p(X: int). .mode p(+string).", "DL0204"),
        (".decl p(X: int). q(X) :- p(X), X = [X].", "DL0200"),
        (".decl q(X: int, Y: int). p(X) :- q(Y, Y), X = [X].", "DL0205"),
        (".decl p(X: int). p(1, 2).", "DL0203"),
        ("p(1). p(1, 2).", "DL0203"),
        (".decl p(X: int, Y: int). .mode p(+int, -int). q(Y) :- p(X, Y).", "DL0301"),
        (".decl p(X: int). .decl q(X: int). p(X) :- q(X), not p(X).", "DL0401"),
        (".decl p(X: int). .decl q(X: int). .decl r(X: int). p(X) :- r(X), not q(X). q(X) :- r(X), not p(X).", "DL0401"),
        (".decl p(X: int). p(N) :- N = count(X : p(X)).", "DL0401"),
        (".decl p(X: int). .decl g(X: int). p(I) :- g(G), choose_topk(\"t\", 1, G, S, I : p(I), p(S)).", "DL0401"),
        (".decl e(X: int). .decl p(X: int). p(X) :- e(X). p(X) :- p(X), N = count(Y : e(Y)), N > X.", "DL0401"),
        (".decl out_status(S: string).", "DL0404"),
        ("out_status(\"ok\").", "DL0404"),
        (".decl p(X: string). out_status(X) :- p(X).", "DL0404"),
        (".decl graph_edge(A: int).", "DL0405"),
        (".decl p(X: int). .decl q(X: int, Y: int). q(X, Y) :- p(X).", "DL0406"),
        (".decl p(X: int). .decl r(X: int). q(X) :- p(X), not r(Y).", "DL0406"),
        (".decl p(X: int). q(X) :- p(X), X != Y.", "DL0406"),
        (".decl p(X: string). q(N) :- N = sum(X : p(X)).", "DL0200"),
        (".decl p(X: int). q(N) :- N = min(p(_)).", "DL0206"),
        (".decl p(X: int). q(N) :- N = count(Y : p(X)).", "DL0206"),
        (".decl p(X: int). .decl g(X: int). q(I) :- g(G), choose_topk(\"t\", 1, G, S, I : p(S)).", "DL0206"),
        (".decl p(X: int, Y: int). q(I) :- choose_topk(\"t\", 1, G, S, I : p(S, I)), p(G, _).  r(I) :- choose_topk(\"t\", 1, G, S, I : p(S, I)).", "DL0301"),
    ],
)
def test_code(source, code):
    with pytest.raises(CompileError) as e:
        compiled(source)
    assert code in e.value.codes, e.value


def test_inferred_schema():
    c = compiled('p(1, "a"). q(some(X), [Y]) :- p(X, Y).')
    assert [str(t) for t in c.predicates["q"].types] == ["option<int>", "list<string>"]


def test_goal_order_follows_modes():
    c = compiled(".decl f(A: int, B: int). .mode f(+int, -int). .decl p(X: int). q(B) :- f(A, B), p(A).")
    assert c.rules[0].order == [1, 0] and c.rules[0].modes == [None, (True, False)]


def test_question_mark_modes():
    c = compiled(".decl f(A: int, B: int). .mode f(?int, -int). q(B) :- f(A, B).")
    assert c.resolved.modes["f"] == [(True, False), (False, False)]


def test_nested_disjunctions_expand():
    assert len(compiled(".decl p(X: int). q(X) :- (p(X) ; (X = 1 ; X = 2)), (p(X) ; X = 3).").rules) == 6


def test_deferred_equality():
    assert compiled(".decl p(X: int). q(X) :- X = Y, p(Y).").rules[0].order == [1, 0]


def test_graph_edge_schema_is_fine():
    compiled(".decl graph_edge(Graph: string, From: Def, To: Def, EdgeKind: string, Evidence: Span).")


def test_strata_and_summary():
    c = compiled(".decl e(X: int, Y: int). r(X, Y) :- e(X, Y). r(X, Y) :- r(X, Z), e(Z, Y). n(X) :- e(X, _), not r(X, X). m(N) :- N = count(X : n(X)).")
    assert c.strata == {"e": 0, "r": 0, "n": 1, "m": 2}
    assert [x.name for x in c.components if x.recursive] == ["r"]
    assert c.summary() == {"predicates": 4, "facts": 0, "rules": 4, "strata": 3, "sccs": 4}


def test_warning_for_overwritten_output():
    assert any("overwritten" in w for w in compiled(".decl p(X: int). q(N) :- p(N), N = count(X : p(X)).").warnings)
