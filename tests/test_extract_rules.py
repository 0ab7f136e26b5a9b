"""Extraction rules, one case per clause (pure Python, no Spark)."""

import ast
import glob

import pytest

from tyscope.operators.extract import (
    _IDX,
    _FileWalk,
    extract_file,
    is_constant,
    probe_of,
    type_count,
)
from tyscope.plans.oracle import TEMPLATE_ANNOTATIONS, TRIAGE_CASES
from tyscope.sources import standins


def run(src: str, path="m.py"):
    out = extract_file(1, path, src.encode())
    kinds = {}
    for r in out:
        kinds.setdefault(r[_IDX["kind"]], []).append({k: r[i] for k, i in _IDX.items()})
    return kinds


def fv(src):
    return [(r["name"], r["lineno"], r["num_var"], r["num_var_annotated"]) for r in run(src).get("func_var", [])]


def an(src):
    return [(r["name"], r["lineno"], r["annot_name"], r["func_var_type"], r["entire_annotation"], r["type_count"])
            for r in run(src).get("annotation", [])]


# ---- two whole modules with their rows
SHAPES = """\
import math
from typing import Sequence

UNIT: float = 1.0
names = ["circle", "square"]


class Shape:
    sides: int

    def __init__(self, sides: int, label=None) -> None:
        self.sides = sides

    def area(self, scale: float = UNIT) -> float:
        def half(x):
            return x / 2
        return half(scale) * self.sides


def largest(shapes: Sequence[Shape], key):
    best = max(shapes, key=key)
    return best


def announce():
    print(names)
"""

STATES = """\
async def poll(url: str):
    status, body = await fetch(url)
    return status
"""


def test_module_of_shapes():
    assert [(r["name"], r["num_annotations"]) for r in run(SHAPES, "geo/shapes.py")["module"]] == [("shapes.py", 7)]
    assert fv(SHAPES) == [
        ("UNIT", 4, 1, 1), ("names", 5, 1, 0), ("sides", 9, 1, 1), ("__init__", 11, 4, 2), ("sides", 12, 1, 0),
        ("area", 14, 3, 2), ("half", 15, 2, 0), ("largest", 20, 3, 1), ("best", 21, 1, 0), ("announce", 25, 0, 0)]
    assert an(SHAPES) == [
        ("UNIT", 4, "UNIT", "variable", "float", 1), ("sides", 9, "sides", "variable", "int", 1),
        ("__init__", 11, "sides", "argument", "int", 1), ("__init__", 11, "", "return", "None", 1),
        ("area", 14, "scale", "argument", "float", 1), ("area", 14, "", "return", "float", 1),
        ("largest", 20, "shapes", "argument", "Sequence[Shape]", 2)]


def test_module_of_states():
    assert [(r["name"], r["num_annotations"]) for r in run(STATES, "io/states.pyi")["module"]] == [("states.pyi", 0)]
    assert fv(STATES) == [("status", 2, 1, 0), ("body", 2, 1, 0)]
    assert an(STATES) == []


def test_standins_use_the_written_out_cases():
    assert standins.TEMPLATE_ANNOTATIONS == [t[0] for t in TEMPLATE_ANNOTATIONS]
    assert standins.TRIAGE_CASES == [t[0] for t in TRIAGE_CASES]


# ---- U1: what counts as a slot
def test_self_counts_and_kwonly_varargs_do_not():
    assert fv("def m(self, a: int, *args, k: int = 1, **kw): pass\n") == [("m", 1, 2, 1)]


def test_posonly_not_counted():
    assert fv("def f(a, /, b: int): pass\n") == [("f", 1, 1, 1)]


def test_async_def_not_counted_but_nested_def_is():
    assert fv("async def g(x: int):\n    def h(y): return y\n    return x\n") == [("h", 2, 2, 0)]


def test_lambda_not_counted():
    assert fv("f = lambda x: x\n") == [("f", 1, 1, 0)]


def test_function_row_before_nested():
    assert [r[0] for r in fv("def a():\n    def b():\n        pass\nclass C:\n    def c(self): pass\n")] == ["a", "b", "c"]


# ---- U6: only top-level returns of a value
@pytest.mark.parametrize("body,slots", [
    ("    return 1\n", 1),
    ("    return\n", 0),
    ("    return None\n", 0),
    ("    if x:\n        return 1\n", 0),
    ("    for i in x:\n        return i\n", 0),
    ("    try:\n        return 1\n    except E:\n        pass\n", 0),
])
def test_contains_return(body, slots):
    assert fv("def f():\n" + body)[0][2] == slots


def test_annotated_return_none_counts():
    assert fv("def f() -> None: pass\n") == [("f", 1, 1, 1)]


# ---- U4 / U5 / U7: variables
def test_ann_assign_without_value():
    assert fv("x: int\n") == [("x", 1, 1, 1)]
    assert an("x: int\n") == [("x", 1, "x", "variable", "int", 1)]


def test_assign_targets():
    assert fv("a, b.c, d[0] = 1, 2, 3\n") == [("a", 1, 1, 0), ("c", 1, 1, 0), ("d", 1, 1, 0)]
    assert fv("[e, f] = g = 0, 1\n") == [("", 1, 1, 0), ("g", 1, 1, 0)]
    assert fv("a = b = 1\n") == [("a", 1, 1, 0), ("b", 1, 1, 0)]
    assert fv("(a, (b, c)) = 1, (2, 3)\n") == [("a", 1, 1, 0), ("", 1, 1, 0)]
    assert fv("*a, b = [1, 2]\n") == [("", 1, 1, 0), ("b", 1, 1, 0)]
    assert fv("f()[0] = 1\n") == [("", 1, 1, 0)]
    assert fv("self.x: int = 1\n") == [("x", 1, 1, 1)]


@pytest.mark.parametrize("src", ["x += 1\n", "for i in y: pass\n", "with a as b: pass\n",
                                 "(y := 3)\n", "import os\n", "from a import b\n"])
def test_not_counted(src):
    assert fv(src) == []


def test_statements_in_all_blocks():
    src = ("if a:\n    x = 1\nelse:\n    y = 2\nwhile b:\n    z = 3\ntry:\n    p = 1\n"
           "except E:\n    q = 2\nelse:\n    r = 3\nfinally:\n    s = 4\n"
           "match v:\n    case 1:\n        t = 5\n")
    assert [r[0] for r in fv(src)] == ["x", "y", "z", "p", "q", "r", "s", "t"]


# ---- U8 / U9: text and type count
@pytest.mark.parametrize("src,text,count", [(s, u, c) for s, u, c in TEMPLATE_ANNOTATIONS] + [
    ("Callable[..., int]", "Callable[..., int]", 3),
    ("np.ndarray", "np.ndarray", 1),
    ("make()", "make()", 1),
    ("Annotated[int, 1:2]", "Annotated[int, 1:2]", 4),
])
def test_type_count_and_text(src, text, count):
    node = ast.parse(f"x: {src}\n").body[0].annotation
    assert ast.unparse(node) == text
    assert type_count(node) == count


def test_documented_count_is_stored():
    assert an("x: Optional[Union[str, int]]\n")[0][-1] == 4


# ---- U10 / U11 / U13 on every triage case
@pytest.mark.parametrize("case", TRIAGE_CASES, ids=[c[0] for c in TRIAGE_CASES])
def test_triage_case(case):
    src, unparsed, tag, value, root, issue, const, count = case
    k = run(f"def f(a: {src}): pass\n")
    a = k["annotation"][0]
    assert a["entire_annotation"] == unparsed
    assert a["root_kind"] == root
    assert (a["issues"][0] if a["issues"] else None) == issue
    assert a["is_constant"] == const
    assert a["type_count"] == count
    node = ast.parse(f"x: {src}\n").body[0].annotation
    assert probe_of(node) == (tag, value)


def test_is_constant_negative_number():
    assert is_constant(ast.parse("x: -1\n").body[0].annotation)
    assert not is_constant(ast.parse("x: ~a\n").body[0].annotation)


# ---- U12 (both readings)
def test_unannotated_names_strict_and_as_coded():
    f = run("def f(a, b: int, c): return a\n")["func_var"][0]
    assert f["unannotated_names"] == ["a", "c"]
    assert f["arg_names_of_partial"] == ["a", "b", "c"]
    full = run("def g(a: int) -> int: return a\n")["func_var"][0]
    assert full["unannotated_names"] is None


# ---- U14 / U15 inputs
def test_probe_inputs():
    f = run("def f(a, /, b: int, c=1, *, d, e=2) -> str: return b\n")["func_var"][0]
    assert [(p["arg"], p["annotated"], p["has_default"]) for p in f["probe_args"]] == [
        ("b", True, False), ("c", False, True)]
    assert f["probe_return"] == {"tag": "str", "value": "str"}
    assert f["n_required_other"] == 2  # a (positional-only) and d (keyword-only)


# ---- C4 / C5 / Q13: rejects
@pytest.mark.parametrize("data,status", [
    (b"def f(:\n", "SyntaxError"),
    (b"\xff\xfe x = 1\n", "UnicodeDecodeError"),
    ("\ufeffx = 1\n".encode(), "SyntaxError"),
    (b"x = 1\x00\n", "SyntaxError"),
])
def test_rejects(data, status):
    out = extract_file(1, "m.py", data)
    assert len(out) == 1 and out[0][_IDX["kind"]] == "reject" and out[0][_IDX["status"]] == status


def test_newlines_normalised():
    assert fv("x = 1\r\ny = 2\rz = 3\n") == [("x", 1, 1, 0), ("y", 2, 1, 0), ("z", 3, 1, 0)]


# ---- D4 support: in-file duplicate keys are flagged, first one kept
def test_duplicate_flags():
    rows = run("a, a = 1, 2\nx: int = 1; x: str = 2\n")
    assert [r["dup"] for r in rows["func_var"]] == [False, True, False, True]
    assert [r["dup"] for r in rows["annotation"]] == [False, True]


# ---- D15 invariant on real code, and the statement-only walk equals a full visit
class _FullWalk(_FileWalk):
    def walk(self, node):
        kind = type(node)
        if kind is ast.FunctionDef:
            self._function(node)
        elif kind is ast.AnnAssign:
            self._ann_assign(node)
            return
        elif kind is ast.Assign:
            self._assign(node)
        for child in ast.iter_child_nodes(node):
            self.walk(child)


def test_walk_equivalence_and_reconcile_on_stdlib():
    files = sorted(glob.glob(ast.__file__.rsplit("/", 1)[0] + "/*.py"))[:150]
    n = 0
    for path in files:
        try:
            tree = ast.parse(open(path, encoding="utf-8").read())
        except (SyntaxError, UnicodeDecodeError, ValueError):
            continue
        a, b = _FullWalk(1, "x"), _FileWalk(1, "x")
        a.walk(tree)
        b.walk(tree)
        assert a.func_vars == b.func_vars and a.annotations == b.annotations, path
        assert sum(r[_IDX["num_var_annotated"]] for r in b.func_vars) == len(b.annotations)
        n += 1
    assert n > 100


def test_a_bug_in_the_walk_fails_the_task(monkeypatch):
    import tyscope.operators.extract as X

    def boom(self, tree):
        raise KeyError("odd")
    monkeypatch.setattr(X._FileWalk, "walk", boom)
    with pytest.raises(KeyError):
        X.extract_file(1, "m.py", b"x = 1\n")


def test_memory_error_is_no_reject_but_the_parser_stack_is(monkeypatch):
    import tyscope.operators.extract as X

    def parse(message):
        def fail(text):
            raise MemoryError(message)
        return fail
    monkeypatch.setattr(X.ast, "parse", parse("Parser stack overflowed - Python source too complex to parse"))
    assert X.extract_file(1, "m.py", b"x = 1\n")[0][_IDX["status"]] == X.PARSER_STACK
    monkeypatch.setattr(X.ast, "parse", parse(""))
    with pytest.raises(MemoryError):
        X.extract_file(1, "m.py", b"x = 1\n")


def test_long_expressions_do_not_depend_on_the_stack():
    k = run("x = " + " + ".join(["a"] * 2000) + "\ny: " + " | ".join(["int"] * 1500) + " = 1\n")
    assert [r["num_annotations"] for r in k["module"]] == [1]
    assert k["annotation"][0]["type_count"] == 1500
    assert k["annotation"][0]["entire_annotation"] == " | ".join(["int"] * 1500)


def test_lone_surrogates_reach_arrow():
    import tyscope.operators.extract as X
    rows = extract_file(1, "m.py", b'def f(a: "\\ud800", b: Literal["\\udc01"]) -> "x\\udfff": pass\n')
    batch = X._to_batch(rows)
    assert batch.num_rows == len(rows) == 5
    probes = [p["probe"]["value"] for r in rows for p in (r[_IDX["probe_args"]] or [])]
    assert probes == ["\\ud800", "\\udc01"]


def test_version_and_first_definitions():
    import platform
    k = run("def f(): pass\ndef g(): pass\nclass C:\n    def f(self): pass\nf = 1\n")
    assert k["module"][0]["python_version"] == platform.python_version()
    assert run("def (")["reject"][0]["python_version"] == platform.python_version()
    assert [(r["name"], r["first_def"]) for r in k["func_var"]] == [("f", True), ("g", True), ("f", False), ("f", None)]


def test_output_leaves_in_bounded_batches():
    import pyarrow as pa

    import tyscope.operators.extract as X
    n = 300
    batch = pa.RecordBatch.from_pydict({"repo_id": list(range(n)), "path_rel": ["m.py"] * n, "content": ["a = b = c = 1\n" * 20] * n})
    sizes = [b.num_rows for b in X._extract_batches(iter([batch]))]
    assert sum(sizes) == n * 61 and max(sizes) < X.FLUSH_ROWS + 61 and len(sizes) > 3


def test_counts_match_plain_ast_walk_on_stdlib():
    """Independent cross-check: per file, rows by kind equal node counts from ast.walk."""
    files = sorted(glob.glob(ast.__file__.rsplit("/", 1)[0] + "/**/*.py", recursive=True))[:300]
    checked = 0
    for path in files:
        try:
            data = open(path, "rb").read()
            tree = ast.parse(data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))
        except (SyntaxError, UnicodeDecodeError, ValueError):
            continue
        defs = [n for n in ast.walk(tree) if type(n) is ast.FunctionDef]
        ann_assigns = [n for n in ast.walk(tree) if type(n) is ast.AnnAssign]
        targets = sum(len(t.elts) if isinstance(t, ast.Tuple) else 1
                      for n in ast.walk(tree) if type(n) is ast.Assign for t in n.targets)
        arg_ann = sum(1 for d in defs for a in d.args.args if a.annotation is not None)
        ret_ann = sum(1 for d in defs if d.returns is not None)
        rows = extract_file(1, "x.py", data)
        fv = [r for r in rows if r[_IDX["kind"]] == "func_var"]
        an = [r for r in rows if r[_IDX["kind"]] == "annotation"]
        assert sum(bool(r[_IDX["is_function"]]) for r in fv) == len(defs), path
        assert len(fv) == len(defs) + len(ann_assigns) + targets, path
        by_kind = {k: sum(r[_IDX["func_var_type"]] == k for r in an) for k in ("argument", "return", "variable")}
        assert by_kind == {"argument": arg_ann, "return": ret_ann, "variable": len(ann_assigns)}, path
        checked += 1
    assert checked > 250
