"""Reply trees of conversations: one fold a conversation over ids, times and links, without the texts.

A fold holds a conversation's ids only and walks links in loops, so replies may be as deep as they like and
may run in circles. Conversations are independent and spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threadlens.schemas import id_part


def _fold(actions: DataFrame, columns: list[str], schema: StructType, run: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    """``run`` over the rows of each conversation, in comment order: time, numeric parts of the id, id."""
    keys = {"_ts": F.unix_micros(F.col("ts").cast("timestamp")), **{f"_p{n}": id_part(F.col("id").cast("string"), n) for n in range(3)}}
    rows = actions.select("conversation_id", "id", *columns, *[c.alias(k) for k, c in keys.items()])
    arrow, names = to_arrow_schema(schema), tuple(keys)
    order = lambda r: (*[(r[k] is not None, r[k] or 0) for k in names], r["id"])  # noqa: E731  nulls first, as in Spark

    def fold(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(run(sorted(table.to_pylist(), key=order))), schema=arrow)

    return rows.groupBy("conversation_id").applyInArrow(fold, schema)


def _depth_first(roots: list[str], children: dict[str, list[str]]) -> Iterator[tuple[str, str, int]]:
    """(id, root, depth) in depth-first order; children stand in the order they were given."""
    for root in roots:
        stack = [(root, 0)]
        while stack:
            node, depth = stack.pop()
            yield node, root, depth
            stack.extend((c, depth + 1) for c in reversed(children.get(node, ())))


def _rooted(ids: list[str], parent: dict[str, str | None]) -> list[str]:
    """The roots among ``ids``: those without a parent, and of each circle of parents the first; its parent is taken away."""
    place, done = {i: n for n, i in enumerate(ids)}, {}
    for i in ids:
        path, at = [], i
        while at is not None and at not in done:
            done[at] = i
            path.append(at)
            at = parent[at]
        if at is not None and done[at] == i:  # this walk came back to itself
            circle = path[path.index(at) :]
            parent[min(circle, key=place.__getitem__)] = None
    return [i for i in ids if parent[i] is None]


def positions(actions: DataFrame) -> DataFrame:
    """(id, conversation_id, root, depth, dfs_index, is_final): where each comment stands in its conversation's reply forest.

    A reply to an unknown comment is a root, as is the first comment of a circle of replies. Children and
    roots stand in comment order; ``is_final`` marks the last in depth-first order.
    """
    schema = actions.select("id", "conversation_id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("dfs_index"), F.lit(True).alias("is_final")).schema

    def run(rows: list[dict]) -> Iterator[dict]:
        ids = [r["id"] for r in rows]
        known = set(ids)
        parent = {r["id"]: r["reply_to"] if r["reply_to"] in known else None for r in rows}
        roots, children = _rooted(ids, parent), {}
        for i in ids:
            if parent[i] is not None:
                children.setdefault(parent[i], []).append(i)
        for n, (i, root, depth) in enumerate(_depth_first(roots, children)):
            yield {"id": i, "conversation_id": rows[0]["conversation_id"], "root": root, "depth": depth, "dfs_index": n, "is_final": n == len(ids) - 1}

    return _fold(actions, ["reply_to"], schema, run)


TREE = "id string, present boolean, latest string, parent string, is_root boolean, depth int, dfs_index bigint, is_final boolean, is_latest boolean"


def structure(rows: list[dict]) -> Iterator[dict]:
    """The live tree of one conversation's actions (id, type, parent_id, reply_to, _ts), given in comment order.

    A comment is present until it is deleted or changed, and again once restored; its latest version is the
    change that took its place, none if it was deleted. A reply to an absent comment belongs to the latest
    version, or else to what the absent one replied to, and so on; a version does not reply to what it
    replaces. Of comments without a target the first is the root and the others are its children. Absent
    comments hang nowhere. Deletions and restorations are no comments.
    """
    by, present, latest = {r["id"]: r for r in rows}, {}, {}
    for r in rows:
        i, kind, p = r["id"], r["type"], r["parent_id"]
        present[i], latest[i] = kind != "DELETION", None if kind == "DELETION" else i
        if p in by and p != i:
            if kind == "RESTORATION":
                present[i], present[p], latest[p] = False, True, p
            else:
                present[p] = False
                latest[p] = i if kind == "MODIFICATION" else None
    comments = [r for r in rows if r["type"] not in ("DELETION", "RESTORATION")]

    def target(r: dict) -> str | None:
        seen, at = {r["id"]}, r["reply_to"]
        while at in by:
            if present.get(at) and at != r["id"]:
                return at
            seen.add(at)
            version = latest.get(at)
            at = version if version is not None and version not in seen else by[at]["reply_to"]
            if at in seen:
                return None
        return None

    ids = [r["id"] for r in comments if present[r["id"]]]
    parent = {i: None for i in ids} | {r["id"]: target(r) for r in comments if present[r["id"]]}
    loose = _rooted(ids, parent)
    for i in loose[1:]:
        parent[i] = loose[0]
    children: dict[str, list[str]] = {}
    for i in ids:
        if parent[i] is not None:
            children.setdefault(parent[i], []).append(i)
    place = {i: (n, depth) for n, (i, _, depth) in enumerate(_depth_first(loose[:1], children))}
    newest = max((r["_ts"] for r in comments if r["_ts"] is not None), default=None)
    last = max((r["id"] for r in comments if r["_ts"] == newest), key=lambda i: place.get(i, (-1, 0))[0], default=None)
    for r in comments:
        i = r["id"]
        n, depth = place.get(i, (None, None))
        yield {
            "id": i, "present": present[i], "latest": latest[i], "parent": parent.get(i), "is_root": bool(loose) and i == loose[0], "depth": depth,
            "dfs_index": n, "is_final": n == len(place) - 1 if n is not None else False, "is_latest": i == last,
        }


def comment_tree(actions: DataFrame) -> DataFrame:
    """TREE with the conversation's id: the live tree of each conversation. ``actions``: id, type, conversation_id, ts, parent_id, reply_to."""
    schema = StructType([*actions.select("conversation_id").schema, *StructType.fromDDL(TREE)])

    def run(rows: list[dict]) -> Iterator[dict]:
        for r in structure(rows):
            yield {"conversation_id": rows[0]["conversation_id"], **r}

    return _fold(actions, ["type", "parent_id", "reply_to"], schema, run)
