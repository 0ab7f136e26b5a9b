"""DuckDB text of the stand-in tables and of each registered query.

The oracle recomputes every result from the benchmark tables with plain SQL
(no Python parsing): for the templated source files the expected fact rows
follow from ``p_size`` alone.
"""

from __future__ import annotations

# Everything expected is written out here; nothing is taken from the code under test.

# The names counted as built-in base types.
BASE_TYPES = [
    "None", "bool", "int", "float", "complex", "str", "bytes", "bytearray", "memoryview", "range", "tuple",
    "list", "set", "frozenset", "dict", "ellipsis", "...", "type", "object", "NoneType", "Any", "Union",
    "Optional", "Callable", "TypeVar", "Generic", "ClassVar", "Final", "Literal", "Annotated", "TypedDict",
    "Protocol", "runtime_checkable", "AbstractSet",
]

# Templated module: annotation, canonical text, type count; by p_size % 13.
TEMPLATE_ANNOTATIONS = [
    ('int', 'int', 1),
    ('Optional[Union[str, int]]', 'Optional[Union[str, int]]', 4),
    ('typing.Optional[int]', 'typing.Optional[int]', 2),
    ('Callable[[int], str]', 'Callable[[int], str]', 3),
    ('"Foo"', "'Foo'", 1),
    ('str | None', 'str | None', 2),
    ('Tuple[int, ...]', 'Tuple[int, ...]', 3),
    ('Literal["a", "b"]', "Literal['a', 'b']", 3),
    ('...', '...', 1),
    ('Dict[str, Any]', 'Dict[str, Any]', 3),
    ('-1', '-1', 1),
    ('None', 'None', 1),
    ('list[int]', 'list[int]', 2),
]

# Files with p_size % 17 = 0 end in a syntax error; folders with p_size % 11 = 0 have no repository.
BROKEN_EVERY = 17
TREE_UNKNOWN_EVERY = 11

# Triage module: annotation, canonical text, probe (tag, value), shape class, shape issue,
# whether it is a constant, type count; argument a takes case pk % 29, b (pk * 7 + 3) % 29,
# the return (pk * 5 + 1) % 29, and pk % 5 = 0 has one more required argument.
TRIAGE_CASES = [
    ('int', 'int', 'str', 'int', 'accepted', None, False, 1),
    ('float', 'float', 'str', 'float', 'accepted', None, False, 1),
    ('Optional[str]', 'Optional[str]', 'str', 'str', 'accepted', None, False, 2),
    ('Union[int, str]', 'Union[int, str]', 'str', 'int', 'accepted', None, False, 3),
    ('Union[List[int], bool]', 'Union[List[int], bool]', 'str', 'bool', 'accepted', None, False, 4),
    ('Union[List[int], Dict[str, int]]', 'Union[List[int], Dict[str, int]]', 'none', None, 'accepted', None, False, 6),
    ('Literal[3]', 'Literal[3]', 'int', '3', 'accepted', None, False, 2),
    ('Literal["int"]', "Literal['int']", 'str', 'int', 'accepted', None, False, 2),
    ('"dict[str, int]"', "'dict[str, int]'", 'error', None, 'accepted', None, True, 1),
    ('"str"', "'str'", 'str', 'str', 'accepted', None, True, 1),
    ('typing.Optional[int]', 'typing.Optional[int]', 'error', None, 'accepted', None, False, 2),
    ('int | None', 'int | None', 'error', None, 'accepted', None, False, 2),
    ('List[int]', 'List[int]', 'error', None, 'accepted', None, False, 2),
    ('None', 'None', 'none', None, 'accepted', None, True, 1),
    ('0', '0', 'int', '0', 'accepted', None, True, 1),
    ('3j', '3j', 'error', None, 'accepted', 'constant:complex', True, 1),
    ('-1', '-1', 'error', None, 'accepted', None, True, 1),
    ('not int', 'not int', 'error', None, 'accepted', 'unary:Not', False, 1),
    ('int or str', 'int or str', 'error', None, 'incorrect', None, False, 0),
    ('{str: int}', '{str: int}', 'error', None, 'incorrect', None, False, 0),
    ('[x for x in y]', '[x for x in y]', 'error', None, 'unexpected', 'unexpected:ListComp', False, 0),
    ('complex', 'complex', 'str', 'complex', 'accepted', None, False, 1),
    ('bool', 'bool', 'str', 'bool', 'accepted', None, False, 1),
    ('Literal[True]', 'Literal[True]', 'bool', 'True', 'accepted', None, False, 2),
    ('Literal[b"x"]', "Literal[b'x']", 'bytes', "b'x'", 'accepted', None, False, 2),
    ('"ERROR"', "'ERROR'", 'error', None, 'accepted', None, True, 1),
    ('""', "''", 'str', '', 'accepted', None, True, 1),
    ('int if x else str', 'int if x else str', 'error', None, 'incorrect', None, False, 0),
    ('"None"', "'None'", 'str', 'None', 'accepted', None, True, 1),
]
TRIAGE_A, TRIAGE_B, TRIAGE_R, TRIAGE_EXTRA_EVERY = (1, 0), (7, 3), (5, 1), 5

# What each probe type name is instantiated with.
PROBE_VALUES = {'int': '10', 'float': '2.0', 'complex': '1j', 'str': "'something'", 'bool': 'True', 'None': 'None'}

# Relational stand-in: annotation texts and their type counts.
STANDIN_ANNOTATIONS = [
    ("None", 1), ("bool", 1), ("int", 1), ("float", 1), ("complex", 1), ("str", 1), ("bytes", 1),
    ("bytearray", 1), ("memoryview", 1), ("range", 1), ("tuple[int]", 2), ("list", 1), ("set[str]", 2),
    ("frozenset", 1), ("dict[str, int]", 3), ("ellipsis", 1), ("...", 1), ("type", 1), ("object", 1),
    ("NoneType", 1), ("Any", 1), ("Union[int, str]", 3), ("Optional[str]", 2), ("Callable", 1),
    ("TypeVar", 1), ("Generic", 1), ("ClassVar[int]", 2), ("Final", 1), ("Literal[1]", 2),
    ("Annotated[int, x]", 3), ("TypedDict", 1), ("Protocol", 1), ("runtime_checkable", 1), ("AbstractSet", 1),
    ("List[int]", 2), ("str | None", 2), ("np.ndarray", 1), ("Foo", 1),
]

# Exception classes that count as bad errors, with their built-in subclasses.
BAD_CLASSES = [
    "NameError", "NotImplementedError", "ImportError", "AttributeError", "ValueError", "RuntimeError", "UnboundLocalError",
    "SyntaxError", "FileNotFoundError", "IndexError", "KeyError", "ZeroDivisionError", "AssertionError",
    "ModuleNotFoundError", "RecursionError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError",
    "UnicodeTranslateError", "IndentationError", "TabError", "PythonFinalizationError",
]
OUTCOME_CLASSES = ["TypeError", *BAD_CLASSES, "OSError", "KeyboardInterrupt", "StopIteration", "MemoryError", "CustomError"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def base_type_sql(x: str) -> str:
    head = f"regexp_extract({x}, '^([^\\[, ]*)', 1)"
    names = ", ".join(_q(n) for n in BASE_TYPES)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' "
            f"WHEN {head} = '...' THEN 'ellipsis' "
            f"WHEN {head} IN ({names}) THEN {head} ELSE 'user_defined' END)")


# ------------------------------------------------------------------ relational stand-ins
REPOSITORY = """repository_t AS (
  SELECT CAST(c_custkey AS INTEGER) AS id,
         CAST(2022 - floor(c_custkey / 1000) AS INTEGER) AS year,
         concat('u', CAST(c_nationkey AS VARCHAR)) AS user_name,
         c_name AS name,
         concat(CAST(CAST(2022 - floor(c_custkey / 1000) AS INTEGER) AS VARCHAR), '-10-28 13:19:39') AS creation_date,
         CAST(floor(c_acctbal) AS INTEGER) AS stars,
         concat('https://example.com/u', CAST(c_nationkey AS VARCHAR), '/', c_name, '.git') AS clone_url
  FROM customer)"""

FUNC_VAR = """func_var_t AS (
  SELECT CAST(o.o_custkey AS INTEGER) AS repo_id,
         concat('pkg/m', CAST(li.l_orderkey % 10 AS VARCHAR), '.py') AS path_rel,
         concat('f', CAST(li.l_orderkey AS VARCHAR)) AS name,
         CAST(li.l_linenumber AS INTEGER) AS lineno,
         CAST(li.q AS INTEGER) % 5 AS num_var,
         least(CAST(li.q AS INTEGER) % 5, CAST(li.p % 5 AS INTEGER)) AS num_var_annotated
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_partkey) AS p
        FROM lineitem GROUP BY l_orderkey, l_linenumber) li
  JOIN orders o ON li.l_orderkey = o.o_orderkey)"""

_TEXTS = "[" + ", ".join(_q(t) for t, _ in STANDIN_ANNOTATIONS) + "]"
_COUNTS = "[" + ", ".join(str(n) for _, n in STANDIN_ANNOTATIONS) + "]"
_AT = f"CAST((CAST(substr(name, 2) AS BIGINT) + lineno + k) % {len(STANDIN_ANNOTATIONS)} AS INTEGER) + 1"

ANNOTATION = f"""annotation_t AS (
  SELECT repo_id, path_rel, name AS func_var_name, lineno,
         CASE WHEN k = num_var THEN '' ELSE concat('a', CAST(k AS VARCHAR)) END AS annot_name,
         CASE WHEN k = num_var THEN 'return' ELSE 'argument' END AS func_var_type,
         {base_type_sql(f"{_TEXTS}[{_AT}]")} AS base_type,
         {_TEXTS}[{_AT}] AS entire_annotation,
         {_COUNTS}[{_AT}] AS type_count
  FROM (SELECT *, unnest(generate_series(1, num_var_annotated)) AS k
        FROM func_var_t WHERE num_var_annotated > 0) s)"""

MODULE = """module_t AS (
  SELECT repo_id, path_rel, regexp_extract(path_rel, '[^/]*$', 0) AS name,
         CAST(sum(num_var_annotated) AS INTEGER) AS num_annotations
  FROM func_var_t GROUP BY repo_id, path_rel)"""

REPO_COUNTED = """repo_counted_t AS (
  SELECT r.*, coalesce(m.annotations_repo, 0) AS annotations_repo
  FROM repository_t r LEFT JOIN
       (SELECT repo_id, CAST(sum(num_annotations) AS BIGINT) AS annotations_repo
        FROM module_t GROUP BY repo_id) m ON r.id = m.repo_id)"""

RELATIONAL = ",\n".join([REPOSITORY, FUNC_VAR, ANNOTATION, MODULE, REPO_COUNTED])


def with_relational(body: str) -> str:
    return f"WITH {RELATIONAL}\n{body}"


# ------------------------------------------------------------------ templated sources (expected rows)
_UNPARSED = "[" + ", ".join(_q(u) for _, u, _ in TEMPLATE_ANNOTATIONS) + "]"
_TCOUNTS = "[" + ", ".join(str(n) for _, _, n in TEMPLATE_ANNOTATIONS) + "]"
_NT = len(TEMPLATE_ANNOTATIONS)

SRC = f"""src_t AS (
  SELECT CAST(p_size AS INTEGER) AS repo_id, concat('pkg/p', CAST(p_partkey AS VARCHAR), '.py') AS path_rel,
         CAST(p_partkey AS VARCHAR) AS pk, p_size AS sz,
         CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS pann,
         CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS ret,
         {_UNPARSED}[CAST(p_size % {_NT} AS INTEGER) + 1] AS t_text,
         {_TCOUNTS}[CAST(p_size % {_NT} AS INTEGER) + 1] AS t_count
  FROM part WHERE p_size % {BROKEN_EVERY} <> 0)"""

X_MODULE = """x_module_t AS (
  SELECT repo_id, path_rel, concat('p', pk, '.py') AS name, CAST(5 + pann + ret AS INTEGER) AS num_annotations
  FROM src_t)"""

_FV_ROWS = [
    ("concat('X', pk)", 2, "1", "0"),
    ("'a'", 3, "1", "0"),
    ("'c'", 3, "1", "0"),
    ("'d'", 3, "1", "0"),
    ("'y'", 4, "1", "1"),
    ("'z'", 6, "1", "1"),
    ("'m'", 7, "3", "pann + ret"),
    ("'inner'", 8, "2", "2"),
    ("'h'", 12, "3", "1"),
    ("''", 15, "1", "0"),
    ("'g'", 15, "1", "0"),
]

X_FUNC_VAR = "x_func_var_t AS (\n" + "\n  UNION ALL ".join(
    f"SELECT repo_id, path_rel, {n} AS name, {ln} AS lineno, CAST({nv} AS INTEGER) AS num_var, "
    f"CAST({na} AS INTEGER) AS num_var_annotated FROM src_t"
    for n, ln, nv, na in _FV_ROWS) + ")"

_AN_ROWS = [
    ("'y'", 4, "'y'", "'variable'", "t_text", "t_count", "TRUE"),
    ("'z'", 6, "'z'", "'variable'", "'int'", "1", "TRUE"),
    ("'m'", 7, "'p'", "'argument'", "'str'", "1", "pann = 1"),
    ("'m'", 7, "''", "'return'", "'int'", "1", "ret = 1"),
    ("'inner'", 8, "'q'", "'argument'", "'float'", "1", "TRUE"),
    ("'inner'", 8, "''", "'return'", "'None'", "1", "TRUE"),
    ("'h'", 12, "'w'", "'argument'", "'str'", "1", "TRUE"),
]

X_ANNOTATION = "x_annotation_t AS (\n" + "\n  UNION ALL ".join(
    f"SELECT repo_id, path_rel, {fv} AS func_var_name, {ln} AS lineno, {an} AS annot_name, "
    f"{fvt} AS func_var_type, {base_type_sql(txt)} AS base_type, {txt} AS entire_annotation, "
    f"CAST({cnt} AS INTEGER) AS type_count FROM src_t WHERE {cond}"
    for fv, ln, an, fvt, txt, cnt, cond in _AN_ROWS) + ")"

# argument names of partially annotated functions: strict (unannotated only) and as coded (all)
X_UNANNOTATED = """x_unannotated_t AS (
  SELECT 'self' AS arg_name FROM src_t WHERE pann + ret > 0
  UNION ALL SELECT 'p' FROM src_t WHERE pann = 0 AND ret = 1
  UNION ALL SELECT concat('v', CAST(sz % 40 AS VARCHAR)) FROM src_t)"""

X_PARTIAL_ARGS = """x_partial_args_t AS (
  SELECT 'self' AS arg_name FROM src_t WHERE pann + ret > 0
  UNION ALL SELECT 'p' FROM src_t WHERE pann + ret > 0
  UNION ALL SELECT concat('v', CAST(sz % 40 AS VARCHAR)) FROM src_t
  UNION ALL SELECT 'w' FROM src_t)"""

EXTRACTED = ",\n".join([SRC, X_MODULE, X_FUNC_VAR, X_ANNOTATION, X_UNANNOTATED, X_PARTIAL_ARGS])


def with_extracted(body: str) -> str:
    return f"WITH {EXTRACTED}\n{body}"


# ------------------------------------------------------------------ search snapshots
SNAP = """snap_t AS (
  SELECT CAST(2013 + c_custkey % 10 AS INTEGER) AS year,
         CAST(it AS INTEGER) AS iteration,
         CAST(c_custkey * 2 + dup AS BIGINT) AS pos,
         CASE WHEN c_custkey % 97 = 0 THEN concat('u', CAST(c_nationkey AS VARCHAR), '/x/', c_name)
              ELSE concat('u', CAST(c_nationkey AS VARCHAR), '/', c_name) END AS name,
         concat('https://example.com/',
                CASE WHEN c_custkey % 97 = 0 THEN concat('u', CAST(c_nationkey AS VARCHAR), '/x/', c_name)
                     ELSE concat('u', CAST(c_nationkey AS VARCHAR), '/', c_name) END, '.git') AS url,
         CAST(floor(c_acctbal) + (c_custkey * it) % 3 - dup AS INTEGER) AS stars,
         concat('20', CAST(13 + c_custkey % 10 AS VARCHAR), '-10-',
                CASE WHEN it = 4 AND c_custkey % 13 = 0 THEN '29' ELSE '28' END, 'T13:19:39Z') AS created_at
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END)) AS dup
        FROM (SELECT *, unnest(generate_series(0, 4)) AS it FROM customer) a
        WHERE (c_custkey + it) % 7 <> 0) b)"""

SNAP_DEDUP = """snap_dedup_t AS (
  SELECT year, iteration, pos, name, url, stars, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY year, iteration, name, created_at
                                 ORDER BY stars DESC, pos) AS rn FROM snap_t) s WHERE rn = 1)"""

MERGED = """merged_t AS (
  SELECT year, CAST(rn - 1 AS INTEGER) AS rank, name, url, stars, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY year ORDER BY stars DESC, iteration, pos) AS rn FROM (
      SELECT *, row_number() OVER (PARTITION BY year, name, created_at
                                   ORDER BY stars DESC, iteration, pos) AS k FROM snap_t) b
    WHERE k = 1) r WHERE rn <= 1000)"""

REPO_RANKED = """repo_ranked_t AS (
  SELECT CAST(o.off + m.rank AS INTEGER) AS id,
         CAST(substr(replace(m.created_at, 'T', ' '), 1, 4) AS INTEGER) AS year,
         split_part(m.name, '/', 1) AS user_name, split_part(m.name, '/', 2) AS name,
         substr(replace(m.created_at, 'T', ' '), 1, length(m.created_at) - 1) AS creation_date,
         m.stars, m.url AS clone_url
  FROM merged_t m JOIN (
    SELECT year, CAST(coalesce(sum(n) OVER (ORDER BY year DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS INTEGER) AS off
    FROM (SELECT year, count(*) AS n FROM merged_t GROUP BY year) c) o ON m.year = o.year
  WHERE len(string_split(m.name, '/')) = 2)"""

RANKING = ",\n".join([SNAP, SNAP_DEDUP, MERGED, REPO_RANKED])


def with_ranking(body: str) -> str:
    return f"WITH {RANKING}\n{body}"


# ------------------------------------------------------------------ triage module (expected rows)
def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    return _q(v)


_CASE_ROWS = ",\n    ".join(
    f"({i}, {_lit(u)}, {_lit(tag)}, {_lit(val)}, {_lit(rk)}, {_lit(iss)}, {_lit(cst)}, {cnt})"
    for i, (_, u, tag, val, rk, iss, cst, cnt) in enumerate(TRIAGE_CASES))

_PV = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in PROBE_VALUES.items())

CASES = f"""cases_t AS (
  SELECT i, unparsed, tag, val, root_kind, issue, is_constant, type_count,
         CASE WHEN tag = 'str' THEN (CASE val {_PV} END)
              WHEN tag = 'none' THEN 'None' WHEN tag = 'error' THEN NULL ELSE val END AS pv
  FROM (VALUES
    {_CASE_ROWS}) v(i, unparsed, tag, val, root_kind, issue, is_constant, type_count))"""

_NC = len(TRIAGE_CASES)

TRI_SRC = f"""tri_src_t AS (
  SELECT CAST(p_size AS INTEGER) AS repo_id, concat('tri/t', CAST(p_partkey AS VARCHAR), '.py') AS path_rel,
         concat('t', CAST(p_partkey AS VARCHAR)) AS name,
         CAST((p_partkey * {TRIAGE_A[0]} + {TRIAGE_A[1]}) % {_NC} AS INTEGER) AS ia,
         CAST((p_partkey * {TRIAGE_B[0]} + {TRIAGE_B[1]}) % {_NC} AS INTEGER) AS ib,
         CAST((p_partkey * {TRIAGE_R[0]} + {TRIAGE_R[1]}) % {_NC} AS INTEGER) AS ir,
         p_partkey % {TRIAGE_EXTRA_EVERY} = 0 AS extra
  FROM part)"""

TRI_DEFS = """tri_defs_t AS (
  SELECT s.repo_id, s.path_rel, s.name, 1 AS lineno,
         CASE WHEN a.pv IS NOT NULL AND b.pv IS NOT NULL THEN concat('a=', a.pv, ';b=', b.pv) END AS probe_call,
         CASE WHEN a.pv IS NULL OR b.pv IS NULL THEN 'Arguments could not be created'
              WHEN s.extra THEN 'Missing'
              WHEN r.tag = 'error' THEN 'ERROR!' ELSE 'checkable' END AS status,
         s.extra
  FROM tri_src_t s JOIN cases_t a ON a.i = s.ia JOIN cases_t b ON b.i = s.ib JOIN cases_t r ON r.i = s.ir)"""

TRI_ANN = """tri_ann_t AS (
  SELECT s.repo_id, c.root_kind, c.issue, c.is_constant
  FROM tri_src_t s JOIN cases_t c ON c.i = s.ia
  UNION ALL SELECT s.repo_id, c.root_kind, c.issue, c.is_constant FROM tri_src_t s JOIN cases_t c ON c.i = s.ib
  UNION ALL SELECT s.repo_id, c.root_kind, c.issue, c.is_constant FROM tri_src_t s JOIN cases_t c ON c.i = s.ir)"""

TRI_FULL = """tri_full_t AS (
  SELECT repo_id, path_rel, name, CAST(9 AS BIGINT) AS sum_num_var, CAST(9 AS BIGINT) AS sum_num_var_annotated
  FROM tri_src_t WHERE NOT extra)"""

DIAG = """diag_t AS (
  SELECT CAST(user_id * 3 AS INTEGER) AS repo_id, concat('tri/t', CAST(event_id % 97 AS VARCHAR), '.py') AS path,
         CAST(floor(value) AS INTEGER) AS line, event_type AS code
  FROM events WHERE event_type = 'error')"""

VERDICT = """verdict_t AS (
  SELECT r.repo_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_diagnostics, coalesce(d.n, 0) = 0 AS clean
  FROM (SELECT DISTINCT repo_id FROM tri_src_t) r
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM diag_t GROUP BY repo_id) d ON r.repo_id = d.repo_id)"""

_CLASSES = "[" + ", ".join(_q(c) for c in OUTCOME_CLASSES) + "]"
_MISSING_TEXT = _q("t() missing 1 required positional argument: 'c'")

OUTCOME = f"""outcome_t AS (
  SELECT event_id, CAST(user_id AS INTEGER) AS repo_id,
         concat('/srv/repos/u', CAST(user_id AS VARCHAR), '/r', CAST(user_id AS VARCHAR), '/tri/t',
                CAST(event_id % 97 AS VARCHAR), '.py') AS file_path,
         concat('t', CAST(event_id % 97 AS VARCHAR)) AS name,
         CASE WHEN event_id % 2 = 0
              THEN {_CLASSES}[CAST(CAST(floor(event_id / 2) AS BIGINT) % {len(OUTCOME_CLASSES)} AS INTEGER) + 1] END AS exc_type,
         CASE WHEN value > 25 THEN {_MISSING_TEXT} ELSE 'unsupported operand type(s)' END AS message,
         event_type = 'view' AND value < 10 AS return_error,
         CASE WHEN event_id % 9 <> 1 THEN value > 10 END AS matched
  FROM events)"""

LABELLED = f"""labelled_t AS (
  SELECT *, CASE WHEN exc_type = 'TypeError' AND contains(message, 'missing') THEN 'Missing'
                 WHEN exc_type = 'TypeError' THEN 'MeinTypeError!'
                 WHEN exc_type IN ({", ".join(_q(c) for c in BAD_CLASSES)}) THEN 'BadError!'
                 WHEN exc_type IS NOT NULL THEN 'Unhandled'
                 WHEN return_error THEN 'ERROR!'
                 WHEN matched IS NULL THEN 'Unchecked'
                 WHEN matched THEN 'True' ELSE 'False' END AS label
  FROM outcome_t)"""

TRIAGE = ",\n".join([CASES, TRI_SRC, TRI_DEFS, TRI_ANN, TRI_FULL, DIAG, VERDICT, OUTCOME, LABELLED])


def with_triage(body: str) -> str:
    return f"WITH {TRIAGE}\n{body}"


# ------------------------------------------------------------------ source tree (expected rows)
TREE_MODULE = f"""tree_module_t AS (
  SELECT CAST(p_size * 100 AS INTEGER) AS repo_id, rel AS path_rel, regexp_extract(rel, '[^/]*$', 0) AS name,
         CAST(5 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END
              AS INTEGER) AS num_annotations
  FROM (SELECT p_size, unnest(CASE p_partkey % 6
          WHEN 0 THEN [concat('pkg/p', CAST(p_partkey AS VARCHAR), '.py')]
          WHEN 3 THEN [concat('pkg/p', CAST(p_partkey AS VARCHAR), '.py'), concat('pkg/p', CAST(p_partkey AS VARCHAR), '.pyi')]
          WHEN 5 THEN [concat('pkg/p', CAST(p_partkey AS VARCHAR), '/mypy.py')]
          ELSE CAST([] AS VARCHAR[]) END) AS rel
        FROM part WHERE p_size % {BROKEN_EVERY} <> 0 AND p_size % {TREE_UNKNOWN_EVERY} <> 0) t)"""

TREE_FOLDER = f"""tree_folder_t AS (
  SELECT CAST(2013 + p_size % 10 AS INTEGER) AS year, concat('u', CAST(p_size % 7 AS VARCHAR)) AS user_name,
         concat('r', CAST(p_size AS VARCHAR)) AS repo, rel AS path_rel,
         CAST(5 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END
              AS INTEGER) AS num_annotations
  FROM (SELECT p_size, unnest(CASE p_partkey % 6
          WHEN 0 THEN [concat('pkg/p', CAST(p_partkey AS VARCHAR), '.py')]
          WHEN 3 THEN [concat('pkg/p', CAST(p_partkey AS VARCHAR), '.py'), concat('pkg/p', CAST(p_partkey AS VARCHAR), '.pyi')]
          WHEN 5 THEN [concat('pkg/p', CAST(p_partkey AS VARCHAR), '/mypy.py')]
          ELSE CAST([] AS VARCHAR[]) END) AS rel
        FROM part WHERE p_size % {BROKEN_EVERY} <> 0) t)"""

TREE_MISSING = f"""tree_missing_t AS (
  SELECT DISTINCT CAST(2013 + p_size % 10 AS INTEGER) AS year, concat('u', CAST(p_size % 7 AS VARCHAR)) AS user_name,
         concat('r', CAST(p_size AS VARCHAR)) AS repo
  FROM part WHERE p_size % {TREE_UNKNOWN_EVERY} = 0)"""


def with_tree(body: str) -> str:
    return f"WITH {TREE_MODULE},\n{TREE_FOLDER},\n{TREE_MISSING}\n{body}"


# ------------------------------------------------------------------ odd files (expected rows)
_ODD_PATH = "concat('odd/o', CAST(p_partkey AS VARCHAR), '.py')"
_LONG_PATH = "concat('odd/', repeat('p', 265))"  # 269 characters


def _odd(kind: int, cols: str) -> str:
    return f"SELECT CAST(p_partkey AS INTEGER) AS repo_id, {cols} FROM part WHERE p_partkey % 10 = {kind}"


ODD_REJECTS = " UNION ALL ".join(
    _odd(k, f"{_ODD_PATH} AS path_rel, '{status}' AS status")
    for k, status in ((1, "UnicodeDecodeError"), (2, "SyntaxError"), (8, "SyntaxError"))) + " UNION ALL " + _odd(
    1, f"concat({_ODD_PATH}, 'i') AS path_rel, 'ContentMissing' AS status")

# kind, path, name, number of annotations
ODD_MODULE = " UNION ALL ".join(
    _odd(k, f"{path} AS path_rel, {name} AS name, {n} AS num_annotations")
    for k, path, name, n in (
        [(k, _ODD_PATH, "concat('o', CAST(p_partkey AS VARCHAR), '.py')", n) for k, n in
         ((0, 3), (3, 1), (4, 2), (5, 0), (7, 1), (9, 1))]
        + [(6, _LONG_PATH, "concat(repeat('p', 270), 'a.py')", 0)]))

_LONG_N, _LONG_Q, _LONG_T = (f"left(repeat('{c}', CAST(p_partkey % 7 AS INTEGER) + {more}), {cap})"
                             for c, more, cap in (("n", 130, 134), ("q", 131, 134), ("T", 536, 539)))

# kind, path, name, line, slots, annotated slots
ODD_FUNC_VAR = " UNION ALL ".join(
    _odd(k, f"{path} AS path_rel, {name} AS name, {line} AS lineno, {nv} AS num_var, {na} AS num_var_annotated")
    for k, path, name, line, nv, na in (
        (0, _ODD_PATH, "'f'", 1, 3, 3),
        (3, _ODD_PATH, "'x'", 1, 1, 0), (3, _ODD_PATH, "'y'", 2, 1, 1),
        (4, _ODD_PATH, "'a'", 1, 1, 0), (4, _ODD_PATH, "'b'", 2, 1, 1), (4, _ODD_PATH, "'g'", 3, 0, 0),
        (4, _ODD_PATH, "'g'", 4, 1, 0),
        (5, _ODD_PATH, "'v'", 1, 1, 0), (5, _ODD_PATH, "'w'", 2, 1, 0),
        (6, _LONG_PATH, "'k'", 1, 1, 0), (6, _LONG_PATH, "'only_in_a'", 2, 1, 0),
        (7, _ODD_PATH, _LONG_N, 1, 1, 1),
        (9, _ODD_PATH, "'x'", 1, 1, 0), (9, _ODD_PATH, "'h'", 2, 3, 1)))

_SURROGATE_A = "concat(chr(39), chr(92), 'ud800', chr(39))"
_SURROGATE_B = "concat('Literal[', chr(39), chr(92), 'ud801x', chr(39), ']')"

# kind, path, name, line, annotation name, kind of slot, base type, text, type count
ODD_ANNOTATION = " UNION ALL ".join(
    _odd(k, f"{path} AS path_rel, {name} AS func_var_name, {line} AS lineno, {an} AS annot_name, '{fvt}' AS func_var_type, "
            f"{bt} AS base_type, {text} AS entire_annotation, {n} AS type_count")
    for k, path, name, line, an, fvt, bt, text, n in (
        (0, _ODD_PATH, "'f'", 1, "'a'", "argument", "'user_defined'", _SURROGATE_A, 1),
        (0, _ODD_PATH, "'f'", 1, "'b'", "argument", "'Literal'", _SURROGATE_B, 2),
        (0, _ODD_PATH, "'f'", 1, "''", "return", "'int'", "'int'", 1),
        (3, _ODD_PATH, "'y'", 2, "'y'", "variable", "'int'", "left(concat('int', repeat(' | int', 299)), 539)", 300),
        (4, _ODD_PATH, "'b'", 2, "'b'", "variable", "'int'", "'int'", 1),
        (5, _ODD_PATH, "'v'", 1, "'v'", "variable", "'int'", "'int'", 1),
        (6, _LONG_PATH, "'k'", 1, "'k'", "variable", "'int'", "'int'", 1),
        (7, _ODD_PATH, _LONG_N, 1, _LONG_Q, "argument", "'user_defined'", _LONG_T, 1),
        (9, _ODD_PATH, "'h'", 2, "'b'", "argument", "'int'", "'int'", 1)))
