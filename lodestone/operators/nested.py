"""Problem 6: nested records as related flat tables, by shared inlining.

A first pass reads the schema graph: which element occurs within which. Elements that repeat (members of arrays), are
shared (occur within more than one other element) or recur (lie on a cycle) get a table; all others are inlined as
columns of the nearest table above. A second pass writes the rows with their keys: a row's own place, and the place
and table of its parent row. Both passes read the values in parallel, and a task reads a value that repeats once; only
the graph, whose size is the schema's and not the data's, comes to the driver; beyond `max_elements` edges, where member
names are data, every element gets a table.

In paths and element names a member's own `.`, `[`, `]`, `@` and backslash are written with a backslash before them, so
that different nodes have different paths.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.shuffle import stage

ROOT = "@record"
_CACHE = 20_000
_ROWS = "table_name string, record_id string, row_path string, parent_table string, parent_path string, ordinal int, columns map<string,string>, twins array<string>"
_ARROW = pa.schema([("table_name", pa.string()), ("record_id", pa.string()), ("row_path", pa.string()), ("parent_table", pa.string()), ("parent_path", pa.string()), ("ordinal", pa.int32()), ("columns", pa.map_(pa.string(), pa.string())), ("twins", pa.list_(pa.string()))])
_TOKEN = re.compile(r"""\s*(?:(?P<open>[\[{])|(?P<close>[\]}])|(?P<mark>[,:])|(?P<str>[uUbBrR]?(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'))|(?P<word>[^\s\[\]{},:"']+))""", re.S)


class _Damaged(ValueError):
    pass


def _scalar(word: str):
    if word in ("null", "None"):
        return None
    if word in ("true", "True", "false", "False"):
        return word.lower() == "true"
    try:
        return float(word) if re.search(r"[.eE]", word) else int(word)
    except ValueError:
        raise _Damaged(word) from None


def _quoted(text: str) -> str:
    text = text.lstrip("uUbBrR")
    if text[0] == '"':
        try:
            return json.loads(text, strict=False)
        except ValueError:
            pass
    try:
        return str(ast.literal_eval(text))
    except (ValueError, SyntaxError):
        return text[1:-1]


def _mixed(text: str):
    """A literal that mixes the notations of JSON and Python."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _Damaged(text[at : at + 10])
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def value():
        nonlocal place
        kind, x = tokens[place]
        place += 1
        if kind == "str":
            return _quoted(x)
        if kind == "word":
            return _scalar(x)
        if kind != "open":
            raise _Damaged(x)
        out, end = ([], "]") if x == "[" else ({}, "}")
        while tokens[place] != ("close", end):
            if end == "]":
                out.append(value())
            else:
                key = value()
                if tokens[place] != ("mark", ":") or isinstance(key, (list, dict)):
                    raise _Damaged("member")
                place += 1
                out[key] = value()
            if tokens[place] == ("mark", ","):
                place += 1
            elif tokens[place] != ("close", end):
                raise _Damaged("no end")
        place += 1
        return out

    got = value()
    if tokens[place][0] != "end":
        raise _Damaged("more")
    return got


def read_value(text: str | None):
    """None, a str, or the dict or list that the text spells; a text that cannot be read whole stays a str.

    A quoted text is read on if an object or array is within the quotes; else the outer text stays as it is.
    """
    if text is None:
        return None
    t = text.strip()
    if t in ("None", "null"):
        return None
    if t[:1] in ("{", "["):
        for read in (json.loads, ast.literal_eval, _mixed):
            try:
                got = read(t)
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                continue
            if isinstance(got, (dict, list)):
                return got
        return text
    if (m := re.match(r"[uUbB]?([\"'])", t)) and len(t) > 2 and t[-1] == m[1]:
        inner = _quoted(t)
        if inner.strip()[:1] in ("{", "["):
            got = read_value(inner)
            return got if isinstance(got, (dict, list)) else text
        if inner.strip() in ("None", "null"):
            return None
    return text


def _name(key) -> str:
    name = key if isinstance(key, str) else str(key)
    return re.sub(r"([\\.\[\]@])", r"\\\1", name)


def _walk(name: str, text: str | None) -> list[tuple]:
    """(path, parent's path or "", element, parent's element, position in an array or None, text or None) of every node, parents first.

    Member names that are equal as texts are one member, the last one.
    """
    name = _name(name)
    out, todo = [], [(name, "", name, ROOT, None, text)]
    while todo:
        path, above, element, within, at, x = todo.pop()
        x = read_value(x) if isinstance(x, str) else x
        if x is None:
            continue
        if isinstance(x, dict):
            out.append((path, above, element, within, at, None))
            todo += [(f"{path}.{k}", path, k, element, None, v) for k, v in reversed({_name(k): v for k, v in x.items()}.items())]
        elif isinstance(x, (list, tuple)):
            out.append((path, above, element, within, at, None))
            todo += [(f"{path}[{i}]", path, f"{element}[]", element, i, v) for i, v in reversed([*enumerate(x)])]
        else:
            out.append((path, above, element, within, at, json.dumps(x) if isinstance(x, (bool, int, float)) else str(x)))
    return out


def _cached(make):
    """make(name, text), kept for values of up to 2,000 characters as long as there are few different ones."""
    seen: dict[tuple, object] = {}

    def get(name, text):
        if len(text) > 2_000:
            return make(name, text)
        if (key := (name, text)) not in seen:
            if len(seen) >= _CACHE:
                seen.clear()
            seen[key] = make(name, text)
        return seen[key]

    return get


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges_of = _cached(lambda name, text: {(within, element) for _, _, element, within, _, _ in _walk(name, text)})
    told: set[tuple] = set()
    for b in batches:
        new = set()
        for name, text in {*zip(b["name"], b["text"])}:
            new |= edges_of(name, text)
        new -= told
        told |= new
        yield pd.DataFrame([*new], columns=["parent", "element"])


def entries(df: DataFrame, record_id: str, attributes: str) -> DataFrame:
    """record_id, attributes, of the records that have any."""
    return df.select(F.col(record_id).cast("string").alias("record_id"), F.col(attributes).alias("attributes")).where(F.size("attributes") > 0)


def schema_graph(records: DataFrame, max_elements: int = 20_000) -> list[tuple[str, str]] | None:
    """The distinct (parent element, element) pairs, sorted; None if there are more than max_elements."""
    members = records.select(F.explode("attributes").alias("name", "text")).where(F.col("text").isNotNull())
    found = members.mapInPandas(_edges, "parent string, element string").distinct().limit(max_elements + 1).collect()
    if len(found) > max_elements:
        return None
    return sorted((r.parent, r.element) for r in found)


def tabled(graph: list[tuple[str, str]] | None) -> set[str] | None:
    """The elements with a table of their own: repeated, shared or recursive ones, and the record. None, for all, without a graph."""
    if graph is None:
        return None
    parents: dict[str, set[str]] = {}
    children: dict[str, set[str]] = {}
    for p, e in graph:
        parents.setdefault(e, set()).add(p)
        children.setdefault(p, set()).add(e)

    def recurs(e: str) -> bool:
        seen, todo = set(), [*children.get(e, ())]
        while todo:
            if (x := todo.pop()) == e:
                return True
            if x not in seen:
                seen.add(x)
                todo += children.get(x, ())
        return False

    return {ROOT} | {e for e, ps in parents.items() if e.endswith("[]") or len(ps) > 1 or recurs(e)}


def _placed(name: str, text: str, tables: set[str] | None) -> tuple[list[tuple], list[list], list[str]]:
    """Of one attribute: the columns of the record's row, the rows of other tables without their record, and all paths."""
    own: list[tuple] = []
    rows: list[list] = []
    home: dict[str, tuple] = {"": (ROOT, "", own)}
    nodes = _walk(name, text)
    for path, above, element, _, at, x in nodes:
        up = home[above]
        if tables is None or element in tables:
            columns = [] if x is None else [("", x)]
            rows.append([element, path, up[0], up[1], at, columns])
            home[path] = (element, path, columns)
        else:
            up[2].append((path[len(up[1]) :].removeprefix("."), x))
            home[path] = up
    return own, rows, [n[0] for n in nodes]


def _plain(path: str) -> str:
    return re.sub(r"\\(.)", r"\1", path, flags=re.S)


def _twins(paths: list[str]) -> set[str]:
    """The paths that read like an earlier one without their backslashes."""
    seen: set[str] = set()
    out: set[str] = set()
    for p in paths:
        out |= {p} if _plain(p) in seen else set()
        seen.add(_plain(p))
    return out


def inlined_rows(records: DataFrame, tables: set[str] | None) -> DataFrame:
    """The rows of all tables, of every element if tables is None: table_name, record_id, row_path, parent_table, parent_path, ordinal, columns, twins.

    (record_id, row_path) is a row's key and (record_id, parent_path) its foreign key into parent_table; row_path is ""
    for the record itself, which has one row if it has any node. columns has the inlined nodes by their path from the
    row, null for objects and arrays; a row that is itself a scalar has it under "". twins are paths of the row's nodes
    that read like another node's of the record once the backslashes are gone; it is null but for such.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = _cached(lambda name, text: _placed(name, text, tables))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [*zip(*out)] or [()] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for b in batches:
            for record, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [placed(name, text) for name, text in members if text is not None]
                paths = [p for part in parts for p in part[2]]
                if not paths:
                    continue
                twins = _twins(paths) if any("\\" in p for p in paths) else ()
                whole = [(ROOT, "", None, None, None, [c for part in parts for c in part[0]]), *(r for part in parts for r in part[1])]
                for table, path, up, above, at, columns in whole:
                    own = [path, *(f"{path}.{c}" if path else c for c, _ in columns if c)]
                    same = [p for p in own if p in twins] if twins else None
                    out.append((table, record, path, up, above, at, columns, same or None))
                if len(out) > 20_000:
                    yield batch()
                    out = []
        yield batch()

    return records.select("record_id", "attributes").mapInArrow(rows, _ROWS)


def flatten(df: DataFrame, record_id: str, attributes: str, max_elements: int = 20_000) -> DataFrame:
    """inlined_rows of a map column of texts. Runs the pass over the schema graph at once.

    Null maps, empty maps and absent values give no rows; a text that is damaged is one scalar; repeated rows repeat.
    """
    records = entries(df, record_id, attributes)
    return inlined_rows(records, tabled(schema_graph(records, max_elements)))


def node_paths(rows: DataFrame) -> DataFrame:
    """record_id, node_path of every node in the tables, rows and inlined columns alike, without backslashes; paths that read alike count once."""
    cols = F.filter(F.map_keys("columns"), lambda k: k != "")
    full = F.transform(cols, lambda k: F.when(F.col("row_path") == "", k).otherwise(F.concat("row_path", F.lit("."), k)))
    own = F.when(F.col("row_path") == "", F.array().cast("array<string>")).otherwise(F.array("row_path"))
    every = F.concat(own, full)
    every = F.when(F.col("twins").isNull(), every).otherwise(F.array_except(every, "twins"))
    return rows.select("record_id", F.explode(every).alias("p")).select("record_id", F.when(F.contains("p", F.lit("\\")), F.regexp_replace("p", "\\\\(.)", "$1")).otherwise(F.col("p")).alias("node_path"))


def table_columns(graph: list[tuple[str, str]] | None, tables: set[str] | None) -> dict[str, list[str]]:
    """The inlined paths of each table, in the graph's order. Without a graph there are none."""
    if graph is None or tables is None:
        return {}
    within = {e: p for p, e in graph if e not in tables}  # such an element has one parent

    def place(e: str) -> tuple[str, str]:
        steps = []
        while e not in tables:
            steps.append(e)
            e = within[e]
        return e, ".".join(reversed(steps))

    out: dict[str, list[str]] = {t: [] for t in sorted(tables)}
    for _, e in graph:
        if e not in tables:
            table, path = place(e)
            out[table].append(path)
    return out


def table_of(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One table with real columns: its keys, `value` for rows that are scalars, and a column for each inlined path named."""
    t = rows.where(F.col("table_name") == name)
    return t.select("record_id", "row_path", "parent_table", "parent_path", "ordinal", F.try_element_at("columns", F.lit("")).alias("value"), *[F.try_element_at("columns", F.lit(c)).alias(c) for c in columns if c])


def flat_tables(df: DataFrame, record_id: str, attributes: str, max_elements: int = 20_000) -> dict[str, DataFrame]:
    """All tables by name with the columns that the schema graph gives them. The rows are staged once.

    Beyond max_elements edges the tables have no inlined columns and are named by the rows themselves; then only
    flatten is of use, and this raises ValueError.
    """
    records = entries(df, record_id, attributes)
    graph = schema_graph(records, max_elements)
    if graph is None:
        raise ValueError("member names are data here; use flatten")
    tables = tabled(graph)
    rows = stage(inlined_rows(records, tables))
    return {t: table_of(rows, t, c) for t, c in table_columns(graph, tables).items()}
