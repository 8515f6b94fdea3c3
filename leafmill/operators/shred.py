"""Adjacency-table shredding of nested JSON records into flat, linked tables.

Every JSON value becomes one node row that stores its parent, label, ordinal and scalar; entity
tables are made by joining object nodes with their scalar children and pivoting the labels. Nothing
is lost on the way: a record can be put together again from its nodes, and from its entity rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("root", T.StringType()),
    ]
)
_KINDS = ("object", "array", "string", "number", "boolean", "null")
_BATCH = 20_000


class _Number(str):
    """A number's own digits, so that no precision is lost and any length is accepted."""


def _refuse(token: str):
    raise ValueError(token)


_LOADS = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse).decode
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))'
)


def _deep(text: str):
    """Parse with an explicit stack, for documents nested beyond the recursion limit."""
    at, end, stack, root, state = 0, len(text.rstrip(" \t\n\r")), [], [], "value"
    # state: value, first (value or ]), key, firstkey (key or }), colon, after
    put = root.append
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or (not stack and root):
            raise ValueError(at)
        at = m.end()
        sign, string, number, word = m.groups()
        if state == "colon":
            if sign != ":":
                raise ValueError(at)
            state = "value"
        elif state in ("key", "firstkey") and string:
            name = _LOADS(string)
            put = lambda v, o=stack[-1], k=name: o.__setitem__(k, v)
            state = "colon"
        elif sign in ("}", "]"):
            top = stack.pop() if stack else None
            if state not in ("after", "first" if sign == "]" else "firstkey") or not isinstance(top, list if sign == "]" else dict):
                raise ValueError(at)
            state = "after"
        elif state == "after":
            if sign != "," or not stack:
                raise ValueError(at)
            state = "value" if isinstance(stack[-1], list) else "key"
            if state == "value":
                put = stack[-1].append
        elif state in ("value", "first"):
            if sign in ("{", "["):
                new = {} if sign == "{" else []
                put(new)
                stack.append(new)
                state = "firstkey" if sign == "{" else "first"
                if sign == "[":
                    put = new.append
            elif sign:
                raise ValueError(at)
            else:
                put(_LOADS(string) if string else _Number(number) if number else {"true": True, "false": False}.get(word))
                state = "after"
        else:
            raise ValueError(at)
    if stack or len(root) != 1:
        raise ValueError("incomplete")
    return root[0]


def _parsed(text: str):
    try:
        return _LOADS(text)
    except RecursionError:
        return _deep(text)


def _clean(s: str) -> str:
    """Escaped lone surrogates have no UTF-8 form; they become U+FFFD."""
    return s if s.isascii() else s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


_ESCAPED = str.maketrans({c: f"\\{c}" for c in ".[\\"})


def _nodes(value, root: str) -> Iterator[tuple]:
    """Depth-first: (path, parent, parent_path, entity, label, ordinal, kind, scalar, field, root)."""
    stack = [(value, root, None, "", root, None, False, None)]
    while stack:
        v, path, parent, above, label, ordinal, element, field = stack.pop()
        if isinstance(v, dict):
            kind, scalar, here = "object", None if v else "{}", path if element else above
            at = "" if element or field is None else f"{field}."
            below = [(w, f"{path}.{k}" if path else k, path, here, k, i, False, at + k.translate(_ESCAPED)) for i, (k, w) in enumerate(zip(map(_clean, v), v.values()))]
        elif isinstance(v, list):
            kind, scalar = "array", None if v else "[]"
            below = [(w, f"{path}[{i}]", path, above, f"[{i}]", i, True, f"{field or ''}[{i}]") for i, w in enumerate(v)]
        else:
            below = ()
            if v is None:
                kind, scalar = "null", None
            elif isinstance(v, bool):
                kind, scalar = "boolean", "true" if v else "false"
            elif isinstance(v, _Number):
                kind, scalar = "number", str(v)
            else:
                kind, scalar = "string", _clean(v)
        yield path, parent, above, "[]" if element else "", label, ordinal, kind, scalar, field or "", root
        stack.extend(reversed(below))


def shred(df: DataFrame, keys: Sequence[str], text: str, root: Column | None = None, kinds: Sequence[str] = _KINDS) -> DataFrame:
    r"""One row per JSON value of column `text`, next to the `keys` of its record.

    `path` joins object keys with `.` and array positions as `[i]`; the record's own root has the
    path `root` (default empty), which column `root` repeats. `parent` is the enclosing node's path (null for the root),
    `parent_path` that of the nearest enclosing object that is an array element (else empty),
    `entity` the path of an array element without its positions (else empty), `ordinal` the
    place among its siblings, `scalar` the value's own text (of an empty container `{}` or `[]`), `field`
    the way from the nearest enclosing array-element object, keys joined by `.`, in which `.`, `[` and
    `\` of a key's own are escaped by `\`. `kinds` keeps nodes of some kinds only, so unwanted rows never leave
    the worker.

    Null, empty and invalid text (cut off, `NaN`, trailing matter) gives no row. Of repeated keys in
    one object the last counts. Any depth and any length of number is accepted. Repeated records
    give repeated rows. Other columns of `df`, whatever their names, are ignored.
    """
    wanted = set(kinds)
    key_fields = [df.schema[k] for k in keys]
    names = [f"k{i}" for i in range(len(keys))]
    source = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("doc"), (root if root is not None else F.lit("")).alias("root"))
    source = source.where(F.col("doc").isNotNull() & (F.length("doc") > 0))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, key_fields)] + NODE.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[] for _ in NODE]

            def flush():
                kept = b.take(pa.array(rows, pa.int32()))
                arrays = [kept.column(i) for i in range(len(names))] + [pa.array(c, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for c, f in zip(cols, NODE)]
                return pa.RecordBatch.from_arrays(arrays, names + NODE.names)

            for i, (doc, at) in enumerate(zip(b.column("doc").to_pylist(), b.column("root").to_pylist())):
                try:
                    value = _parsed(doc)
                except ValueError:
                    continue
                for node in _nodes(value, at or ""):
                    if node[6] not in wanted:
                        continue
                    rows.append(i)
                    for c, x in zip(cols, node):
                        c.append(x)
                    if len(rows) >= _BATCH:
                        yield flush()
                        rows, cols = [], [[] for _ in NODE]
            if rows:
                yield flush()

    out = source.mapInArrow(run, schema)
    entity = F.when(F.col("entity") != "", F.regexp_replace("path", r"\[[0-9]+\]", "[]")).otherwise("")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[entity.alias("entity") if f == "entity" else F.col(f) for f in NODE.names])


def elements(nodes: DataFrame) -> DataFrame:
    """The object nodes that are array elements: the rows of the entity tables."""
    return nodes.where((F.col("kind") == "object") & (F.col("entity") != ""))


def _is_leaf() -> Column:
    return ~F.col("kind").isin("object", "array") | F.col("scalar").isNotNull()


def _text(c: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def entity_rows(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, entity, path, parent_path, place, ordinal, kind, fields, kinds): one row per record part that is a thing of its own.

    These are the objects that are array elements, the other elements of arrays (lists of plain values
    become child tables of `value`), and the root of each record (entity ''). `fields` maps the labels
    of all scalars between a row and the next rows below it to their text, also those of nested plain
    objects (`meta.k`), nulls, and empty containers (`{}`, `[]`); `kinds` maps them to their types.
    `parent_path` names the row above and `place` is the way from there.

    The object nodes are joined with their scalar children, which are gathered by parent first: of two
    nodes of one path (keys that hold a `.`) the fields come together. Repeated nodes count once.
    """
    own = F.struct(*keys, "path").alias("id")  # one key, in which nulls are equal
    things = nodes.where((F.col("entity") != "") & ((F.col("kind") == "object") | _is_leaf()) | F.col("parent").isNull() & ((F.col("kind") == "object") | _is_leaf()))
    pick = F.struct("entity", "parent_path", F.col("field").alias("place"), "ordinal", "kind")
    things = things.groupBy(own).agg(F.min(pick).alias("t"))
    inside = _is_leaf() & ((F.col("kind") != "object") | ((F.col("entity") == "") & F.col("parent").isNotNull()))
    alone = (F.col("entity") != "") | F.col("parent").isNull()
    children = nodes.where(inside).select(
        F.struct(*keys, F.when(alone, F.col("path")).otherwise(F.when(F.col("parent_path") != "", F.col("parent_path")).otherwise(F.col("root"))).alias("path")).alias("id"),
        F.struct(F.when(alone, "value").otherwise(F.col("field")).alias("label"), "kind", "scalar").alias("f"),
    )
    children = children.groupBy("id").agg(F.array_sort(F.collect_set("f")).alias("f"))
    # of fields that come together under one label the last counts
    children = children.withColumn("f", F.filter("f", lambda x, i: (i == F.size("f") - 1) | (F.get("f", i + 1)["label"] != x["label"])))
    x = things.join(children, "id", "left")
    pairs = lambda c: F.coalesce(F.map_from_entries(F.transform("f", lambda x: F.struct(x["label"], x[c]))), F.create_map().cast("map<string,string>"))
    return x.select(*[F.col(f"id.{k}").alias(k) for k in keys], "t.entity", "id.path", "t.parent_path", "t.place", "t.ordinal", "t.kind", pairs("scalar").alias("fields"), pairs("kind").alias("kinds"))


def fields_json(fields: str = "fields", kinds: str = "kinds") -> Column:
    """The fields of an entity row as one JSON object, typed as they were, labels in order."""
    value = lambda k: F.when(F.col(kinds)[k] == "string", _text(F.col(fields)[k])).otherwise(F.coalesce(F.col(fields)[k], F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(_text(k), F.lit(":"), value(k))), ","), F.lit("}"))


def entity_table(nodes: DataFrame, keys: Sequence[str], entity: str, labels: Sequence[str] | None = None, most: int = 2000, nulls: bool = False) -> DataFrame:
    """Pivot one entity (an `entity` value such as `a.b[].c[]`) into a flat table, a column a label.

    `labels` fixes the columns; without it they are discovered, which collects one name per column
    and refuses more than `most`. Null elements give a row only with `nulls`. A label that clashes with a key or link column gets the prefix `f_`.
    """
    rows = entity_rows(nodes, keys).where((F.col("entity") == entity) & (F.lit(nulls) | (F.col("kind") != "null")))
    if labels is None:
        labels = sorted(r[0] for r in rows.select(F.explode(F.map_keys("fields"))).distinct().limit(most + 1).collect())
        if len(labels) > most:
            raise ValueError(f"more than {most} labels in {entity}")
    taken = {x.lower() for x in (*keys, "path", "parent_path", "ordinal")}
    return rows.select(*keys, "path", "parent_path", "ordinal", *[F.col("fields")[x].alias(f"f_{x}" if x.lower() in taken else x) for x in labels])
