"""Deeply nested records to flat tables, routed by structural variant.

A tree automaton runs over each parsed answer.  Bottom-up every node gets its shape: a leaf is null, flag, number
or text, an array the set of its items' shapes, an object its keys with their values' shapes, where what lies
below another object is folded, so that shapes are finite at any depth.  Top-down every node gets its role: the
parent's role, the key it hangs on and its shape lead to one by the transition table, to none where the table has
no entry.  Role and shape are the node's state: a structural variant.  A variant is routed to the typed subtype table
of its role: the supertype keys (bio_id, parent_path, node_path, depth, kind, variant) are the same in all tables,
the typed columns are the subtype's, and fields whose shape does not fit the type stay as JSON in ``rest``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meibo.functions.jsonfix import BROKEN, NOTHING, parse_answer

RELATIVE, EDUCATION, CAREER = "relative", "education", "career"
ANSWER = "answer"
#: the automaton's transitions: (role of an object, key) -> role of the objects that hang on it, directly or as items
TRANSITIONS = {(ANSWER, "family_member"): RELATIVE, (RELATIVE, "family_member"): RELATIVE, (RELATIVE, "education"): EDUCATION, (RELATIVE, "career"): CAREER}
#: the letter of a role in a path
LETTERS = {RELATIVE: "f", EDUCATION: "e", CAREER: "c"}
TYPED = {
    RELATIVE: {"name": str, "relation": str, "birth_year": int, "birth_year_raw": str, "place": str},
    EDUCATION: {"institution": str, "major_of_study": str, "year_graduated": int, "year_raw": str},
    CAREER: {"job_title": str, "organization": str, "start_year": int, "start_year_raw": str, "place_name": str, "is_current": bool},
}
_ALIASES = {"current": "is_current"}
_SUPER = [("bio_id", pa.int64()), ("parent_path", pa.string()), ("node_path", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("variant", pa.string())]
_FIELDS: dict[str, type] = {k: t for fields in TYPED.values() for k, t in fields.items()}
_ARROW = {str: pa.string(), int: pa.int32(), bool: pa.bool_()}
_SCHEMA = pa.schema([*_SUPER, *[(k, _ARROW[t]) for k, t in _FIELDS.items()], ("rest", pa.string())])
_DDL = "bio_id bigint, parent_path string, node_path string, depth int, kind string, variant string, " + ", ".join(
    f"{k} {'string' if t is str else 'int' if t is int else 'boolean'}" for k, t in _FIELDS.items()
) + ", rest string"


def leaf_state(v: object) -> str:
    """The automaton's state of a scalar."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "flag"
    return "number" if isinstance(v, (int, float)) else "text"


def folded(v: object) -> str:
    """The state of a value as its parent sees it: what lies below an object is folded."""
    if isinstance(v, dict):
        return "{}"
    if isinstance(v, list):
        return "[" + "|".join(sorted({"{}" if isinstance(c, dict) else "[]" if isinstance(c, list) else leaf_state(c) for c in v})) + "]"
    return leaf_state(v)


def state_of(role: str, obj: dict) -> str:
    """The state of an object: its role and its shape."""
    return role + "{" + ",".join(f"{k}:{folded(obj[k])}" for k in sorted(obj)) + "}"


def role_of(state: str) -> str:
    """The role in a state, which is the subtype table its variant is routed to."""
    return state.partition("{")[0]


def _fit(value: object, kind: type) -> tuple[object, bool]:
    """(typed value, whether it fitted)."""
    if value is None:
        return None, True
    if isinstance(value, list) and len(value) == 1:
        value = value[0]
    if kind is str and isinstance(value, str):
        return value, True
    if kind is bool and isinstance(value, bool):
        return value, True
    if kind is int and not isinstance(value, bool):
        if isinstance(value, int) and abs(value) < 2**31:
            return value, True
        if isinstance(value, float) and value.is_integer() and abs(value) < 2**31:
            return int(value), True
        if isinstance(value, str) and value.strip().lstrip("-").isdecimal() and len(value.strip()) < 10:
            return int(value.strip()), True
    return None, False


def _as_items(value: object) -> list:
    """Array items by position; a single object in place of an array stands at position 0.

    An array or object written as JSON inside a string is read as what it says.
    """
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{", '"'):
        value = parse_answer(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def flatten(bio_id: int, answer: object) -> Iterator[dict]:
    """One row per object that the automaton gives a role, in document order, routed by its state."""
    if isinstance(answer, dict) and set(answer) == {"family_member"}:
        answer = answer["family_member"]

    def below(role: str, key: str, value: object, parent: str, depth: int) -> list[tuple]:
        to = TRANSITIONS.get((role, key))
        if to is None:
            return []
        at = f"{parent}/{LETTERS[to]}" if parent else LETTERS[to]
        return [(state_of(to, v), f"{at}{k}", parent, depth, v) for k, v in enumerate(_as_items(value)) if isinstance(v, dict)]

    stack = below(ANSWER, "family_member", answer, "", 0)[::-1]
    while stack:
        state, path, parent, depth, obj = stack.pop()
        role = role_of(state)
        typed = TYPED[role]
        row: dict = {"bio_id": bio_id, "parent_path": parent, "node_path": path, "depth": depth, "kind": role, "variant": state}
        rest, children = {}, []
        for key, value in obj.items():
            if (role, key) in TRANSITIONS:
                continue
            name = _ALIASES.get(key, key)
            if name in typed:
                row[name], fitted = _fit(value, typed[name])
                if fitted:
                    continue
            rest[key] = value
        row["rest"] = _dump(rest) if rest else None
        yield row
        for r, key in TRANSITIONS:
            if r == role and key in obj:
                children += below(role, key, obj[key], path, depth + 1)
        stack += children[::-1]


def _dump(value: object) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, default=str)
    except (RecursionError, ValueError):
        return "<too deep>"


def nested_nodes(records: DataFrame, key: str = "bio_id", answer: str = "family_member") -> DataFrame:
    """All objects of all answers as rows (see ``flatten``), Arrow batch by Arrow batch without a shuffle.

    Null, empty, valueless and broken-off answers give no rows, as do items that are no objects
    (they keep their position).  Rows with a null key are left out.  Depth is bounded by memory only.
    """
    src = records.select(F.col(key).cast("bigint").alias("bio_id"), F.col(answer).alias("answer")).where(F.col("bio_id").isNotNull() & F.col("answer").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for bio, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse_answer(text)
                if value is not BROKEN and value is not NOTHING:
                    rows.extend(flatten(bio, value))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return src.mapInArrow(run, _DDL)


def subtype_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The typed table of one subtype, to which the variants of its role are routed: the supertype keys, its own columns, and ``rest``."""
    own = [k for k in TYPED[kind]]
    return nodes.where(F.substring_index("variant", "{", 1) == kind).select(*[n for n, _ in _SUPER], *own, "rest")


def variant_catalogue(nodes: DataFrame) -> DataFrame:
    """Each structural variant of each subtype with its number of objects."""
    return nodes.groupBy("kind", "variant").agg(F.count(F.lit(1)).alias("n_objects"), F.max("depth").alias("deepest"))
