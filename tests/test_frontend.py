"""Lexer, parser, includes."""

import pytest

from siltstone.syntax import CompileError, load_program, parse_program
from siltstone.syntax import ast as A

FULL = """
.type Color = { RED, GREEN, BLUE }.
.mode reach(+int, ?int).
.pragma max_iters = 40.
.decl edge(From: int, To: int) extern.
.func name(K: int, N: option<list<string>>) input output.
edge(1, -2).
reach(A, C) :- edge(A, B), not edge(B, A), (B = C ; reach(B, C)), N = count(X : edge(X, B)), choose_topk("t", 3, A, S, I : edge(I, S)), V := -(A + 2) * 3 / B, V >= 0.
"""


def codes(source):
    with pytest.raises(CompileError) as e:
        parse_program(source)
    return e.value


def test_full_surface():
    p = parse_program(FULL)
    assert [type(s).__name__ for s in p.statements] == ["EnumDecl", "ModeDecl", "Pragma", "PredDecl", "PredDecl", "Fact", "Rule"]
    body = p.statements[-1].body
    assert [type(g).__name__ for g in body] == ["Atom", "Not", "Disjunction", "Aggregate", "TopK", "Assign", "Compare"]
    assert body[5].expr.op == "/" and body[5].expr.a.op == "*" and body[5].expr.a.a.op == "neg"
    assert p.statements[4].attrs == {"input", "output"} and str(p.statements[4].args[1][1]) == "option<list<string>>"


def test_terms():
    p = parse_program('p(X, _, 3, -4, "a\\"\\n", true, C::RED, none, none::<int>, some([1, 2]), []::<string>).')
    args = p.statements[0].atom.args
    assert [type(t).__name__ for t in args] == ["Var", "Wild", "Lit", "Lit", "Lit", "Lit", "Enum", "NoneTerm", "NoneTerm", "Some", "ListTerm"]
    assert args[3].value == -4 and args[4].value == 'a"\n' and args[8].ty == A.INT and args[10].ty == A.STRING


def test_comments():
    assert len(parse_program("% a\n// b\n/* c /* d */ e */ p(1).").statements) == 1


@pytest.mark.parametrize(
    "source, code, text",
    [
        ("p(9223372036854775808).", "DL0001", "64 bits"),
        ("p('x').", "DL0001", "unexpected"),
        ('p("abc', "DL0001", "not closed"),
        ('p("\\q").', "DL0001", "escape"),
        ("/* p(1).", "DL0001", "not closed"),
        ("p(1", "DL0002", "expected `)`"),
        ("p(X) :- .", "DL0002", "at least one goal"),
        ("p(X) :- q(X), .", "DL0002", "ends in a comma"),
        ("p(X) :- (q(X)).", "DL0002", "needs `;`"),
        ("p(X) :- X = avg(Y : q(Y)).", "DL0002", "unknown aggregate"),
        (".nope.", "DL0002", "unknown directive"),
        ("P(1).", "DL0002", "cannot be a predicate"),
        ("p(x).", "DL0002", "no term"),
        ('.include "a".', "DL0004", "without a file"),
    ],
)
def test_errors(source, code, text):
    e = codes(source)
    assert e.codes[0] == code and text in str(e)


def test_recovery_goes_on_after_the_statement():
    e = codes("p(1 2 3). q(. r(1). s(x).")
    assert len(e.diagnostics) >= 3 and "skipped" in str(e)


def test_includes(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "b.dl").write_text('p(2).')
    (tmp_path / "a.dl").write_text('.include "b.dl".\np(1).')
    p = load_program(tmp_path / "a.dl", [tmp_path / "lib"])
    assert [s.atom.args[0].value for s in p.statements] == [2, 1]
    with pytest.raises(CompileError) as e:
        load_program(tmp_path / "a.dl")
    assert e.value.codes == ["DL0004"]
    (tmp_path / "c.dl").write_text('.include "d.dl".')
    (tmp_path / "d.dl").write_text('.include "c.dl".')
    with pytest.raises(CompileError) as e:
        load_program(tmp_path / "c.dl")
    assert e.value.codes == ["DL0003"]
    (tmp_path / "bad.dl").write_text("p(")
    (tmp_path / "e.dl").write_text('.include "bad.dl".')
    with pytest.raises(CompileError) as e:
        load_program(tmp_path / "e.dl")
    assert e.value.codes == ["DL0002"] and e.value.diagnostics[0].includes
    with pytest.raises(CompileError) as e:
        load_program(tmp_path / "none.dl")
    assert e.value.codes == ["DL0005"]


def test_standard_library_loads():
    from pathlib import Path

    import siltstone
    from siltstone.plans import compile_program

    c = compile_program(load_program(Path(siltstone.__file__).parent / "std" / "callers.dl"))
    assert c.summary()["predicates"] > 70 and not any(x.recursive for x in c.components)
