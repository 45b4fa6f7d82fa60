"""From the ordered revisions of a page to its stream of comment actions.

A page is a text cut into comments. Each revision is compared with the one before; what it inserts,
deletes and changes becomes actions: CREATION of a heading, ADDITION, MODIFICATION, DELETION and
RESTORATION, each with the comment it replies to, the conversation it belongs to, and its authors. The
fold over a page's revisions is sequential; pages are independent and run side by side.

State between batches is one row a page, so a page can be carried on from where it ended.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from threadlens.functions.text import clean_html
from threadlens.operators.textdiff import diff
from threadlens.schemas import ACTION, ERROR, PAGE_STATE

#: Deleted texts longer than the first and shorter than the second number can be restored.
REMEMBER = (10, 1000)
#: A removed comment longer than this that turns up in an insertion has been moved.
MOVE_LEAST = 10
#: What marks a comment that starts anew at the margin though it answers the one before.
OUTDENT = "[OUTDENT: "
#: Revisions after which deleted texts of the batch before are forgotten.
RELOAD = 100

Author = tuple[str | None, str | None]


@dataclass
class Comment:
    start: int
    id: str
    indent: int


@dataclass
class Page:
    """The comments of a page in order, and what is known of each by id."""

    page_id: str
    title: str | None = None
    text: str = ""
    rev_id: int = -1
    timestamp: str | None = None
    comments: list[Comment] = field(default_factory=list)
    deleted: dict[str, tuple[str, int]] = field(default_factory=dict)
    older_deleted: dict[str, tuple[str, int]] = field(default_factory=dict)
    conversations: dict[str, str] = field(default_factory=dict)
    ancestors: dict[str, str] = field(default_factory=dict)
    authors: dict[str, list[Author]] = field(default_factory=dict)
    seen: int = 0

    def end(self, k: int) -> int:
        return self.comments[k + 1].start if k + 1 < len(self.comments) else len(self.text)

    def check(self) -> None:
        """Comments start at 0, ascend, and lie within the text."""
        check(self.text, self.comments)


def check(text: str, comments: list[Comment]) -> None:
    starts = [c.start for c in comments]
    if text and (not starts or starts[0] != 0):
        raise AssertionError("the first comment must start at 0")
    if starts != sorted(set(starts)) or (starts and starts[-1] >= max(len(text), 1)):
        raise AssertionError("comments must ascend within the text")


def heading(line: str) -> bool:
    line = line.strip()
    left = len(line) - len(line.lstrip("="))
    return 0 < left < len(line) and left == len(line) - len(line.rstrip("="))


def indentation(text: str) -> int:
    """-1 for a heading, else the count of leading ``:`` and ``*`` of the first line that isn't empty."""
    line = next((x for x in text.split("\n") if x.strip()), "")
    return -1 if heading(line) else len(line) - len(line.lstrip(":*"))


def cut_comments(text: str) -> list[tuple[int, str]]:
    """An inserted text as headings and bodies: (offset, part)."""
    parts: list[tuple[int, str]] = []
    at = 0
    for line in text.splitlines(keepends=True):
        if heading(line) or not parts or heading(parts[-1][1].split("\n")[0]):
            parts.append((at, line))
        else:
            parts[-1] = (parts[-1][0], parts[-1][1] + line)
        at += len(line)
    return parts


_RE_CLEAN = re.compile("--")


def clean_content(text: str) -> str:
    return _RE_CLEAN.sub("", text).replace(" :", " ")


class Fold:
    """Applies revisions to a page and yields its actions."""

    def __init__(self, page: Page):
        self.page = page

    def _action(self, kind: str, text: str, action_id: str, rev: dict, parent: str | None, reply: str | None, indent: int) -> dict:
        p = self.page
        me: Author = (rev.get("user_id"), rev.get("user_text"))
        if kind in ("DELETION", "RESTORATION"):
            conversation, ancestor, authors = p.conversations.get(parent), p.ancestors.get(parent, parent), list(p.authors.get(parent, []))
        else:
            conversation = p.conversations.get(reply, action_id) if reply else action_id
            ancestor = p.ancestors.get(parent, parent) if parent else action_id
            authors = list(dict.fromkeys([*p.authors.get(parent, []), me])) if parent else [me]
        p.conversations[action_id], p.ancestors[action_id], p.authors[action_id] = conversation or action_id, ancestor, authors
        return {
            "id": action_id, "type": kind, "content": text, "cleaned_content": clean_content(text), "user_id": me[0], "user_text": me[1],
            "timestamp": rev.get("timestamp"), "parent_id": parent, "replyTo_id": reply, "indentation": indent, "rev_id": rev["rev_id"],
            "page_id": p.page_id, "page_title": p.title, "conversation_id": conversation or action_id, "ancestor_id": ancestor,
            "authors": [{"user_id": a, "user_text": b} for a, b in authors],
        }

    def apply(self, rev: dict) -> list[dict]:
        """Actions of one revision, whose ``text`` is clean; the page then stands at that revision.

        A revision that breaks the page's invariants leaves the page as it was.
        """
        p, out = self.page, []
        title, deleted, older = p.title, dict(p.deleted), dict(p.older_deleted)
        try:
            self._apply(rev, out)
        except AssertionError:
            p.title, p.deleted, p.older_deleted = title, deleted, older
            for action in out:
                for known in (p.conversations, p.ancestors, p.authors):
                    known.pop(action["id"], None)
            raise
        return out

    def _apply(self, rev: dict, out: list[dict]) -> None:
        p, new = self.page, rev["text"] or ""
        p.title = rev.get("page_title") or p.title
        old, ops = p.text, diff(p.text, new)
        kept: dict[int, list[tuple[int, int]]] = {}  # comment: what of it stays, as new spans
        touched: set[int] = set()
        starts = [c.start for c in p.comments]

        def owner(offset: int) -> int:
            return bisect_right(starts, offset) - 1

        inserts: list[tuple[int, int, int]] = []  # (old place, new start, new end)
        for op in ops:
            if op.name == "insert":
                inserts.append((op.a1, op.b1, op.b2))
                continue
            a = op.a1
            while a < op.a2:
                k = owner(a)
                z = min(op.a2, p.end(k))
                if op.name == "equal":
                    kept.setdefault(k, []).append((op.b1 + a - op.a1, op.b1 + z - op.a1))
                else:
                    touched.add(k)
                a = z
        removed = [k for k in range(len(p.comments)) if k not in kept or not any(new[x:y].strip() for x, y in kept[k])]
        gone = set(removed)
        pieces: list[tuple[int, int, str | None, int | None, bool]] = []  # (new start, new end, kind, old comment, whole)
        additions: list[tuple[int, int, int]] = []
        for at, x, y in inserts:
            whole_lines = (x == 0 or new[x - 1] == "\n" or new[x] == "\n") and (y == len(new) or new[y - 1] == "\n")
            k = owner(at) if p.comments else -1
            before = owner(at - 1) if at > 0 and p.comments else -1
            inside = k >= 0 and k not in gone and p.comments[k].start < at < p.end(k)
            at_edge = at == len(old) or (k >= 0 and p.comments[k].start == at)
            if whole_lines:
                additions.append((x, y, at))
                if inside:
                    touched.add(k) if not at_edge and not (old[at - 1] == "\n") else None
            else:
                near = k if k >= 0 and k not in gone and p.comments[k].start <= at < p.end(k) else before
                if near >= 0 and near not in gone:
                    touched.add(near)
                    kept[near].append((x, y))
                else:
                    additions.append((x, y, at))
        # moved comments: removed here and found in an addition
        free = list(additions)
        deletions = [op for op in ops if op.name == "delete"]
        moved: list[tuple[int, int, int]] = []
        for k in removed:
            text = old[p.comments[k].start : p.end(k)]
            if len(text) <= MOVE_LEAST:
                continue
            for n, (x, y, at) in enumerate(free):
                found = new.find(text, x, y)
                if found >= 0:
                    moved.append((found, found + len(text), k))
                    free[n : n + 1] = [s for s in ((x, found, at), (found + len(text), y, at)) if new[s[0] : s[1]].strip()]
                    break
        moved_comments = {k for _, _, k in moved}
        for k in removed:
            if k in moved_comments:
                continue
            c, text = p.comments[k], old[p.comments[k].start : p.end(k)]
            if not text.strip():
                continue
            reply = self._reply(p.comments, k, c.indent)
            place = next((op.b1 for op in deletions if op.a1 < p.end(k) and op.a2 > c.start), 0)
            out.append(self._action("DELETION", text, f"{rev['rev_id']}.{place}.{c.start}", rev, c.id, reply, c.indent))
            if REMEMBER[0] < len(text) < REMEMBER[1]:
                p.deleted[text] = (c.id, c.indent)
        for x, y, k in moved:
            pieces.append((x, y, "moved", k, False))
        for k, spans in kept.items():
            if k in gone:
                continue
            spans.sort()
            # an insertion of whole lines splits a comment; its first run keeps the id
            runs: list[list[int]] = []
            cuts = sorted(x for x, _, _ in free)
            for x, y in spans:
                if runs and not any(runs[-1][1] <= c < x for c in cuts):
                    runs[-1][1] = y
                else:
                    runs.append([x, y])
            for n, (x, y) in enumerate(runs):
                if new[x:y].strip() or n == 0:
                    pieces.append((x, y, "kept" if n == 0 else "split", k, k in touched and n == 0))
        known = {**p.older_deleted, **p.deleted}
        places: dict[int, int] = {}  # new start of an inserted piece: where in the old text it came
        for x, y, old_place in free:
            rest = [(x, y)]
            for text in sorted((t for t in known if t in new[x:y]), key=lambda t: (-len(t), t)):
                for n, (s, e) in enumerate(rest):
                    found = new.find(text, s, e)
                    if found >= 0:
                        pieces.append((found, found + len(text), "restored", None, False))
                        places[found] = old_place
                        rest[n : n + 1] = [z for z in ((s, found), (found + len(text), e)) if z[1] > z[0]]
                        break
            for s, e in rest:
                if new[s:e].strip():
                    parts = [(s + at, s + at + len(part), "added", None, False) for at, part in cut_comments(new[s:e])]
                    places.update({q[0]: old_place for q in parts})
                    pieces += parts
        pieces.sort(key=lambda q: (q[0], q[1]))
        comments: list[Comment] = []
        for x, y, kind, k, changed in pieces:
            start = 0 if not comments else x
            if comments and start <= comments[-1].start:
                continue
            text = new[x:y]
            if kind in ("moved", "kept", "split") and not changed:
                comments.append(Comment(start, p.comments[k].id, p.comments[k].indent))
                continue
            if kind == "kept":
                indent = indentation(text)
                comments.append(Comment(start, "", indent))
                action_id = f"{rev['rev_id']}.{x}.{p.comments[k].start}"
                action = self._action("MODIFICATION", text, action_id, rev, p.comments[k].id, self._reply(comments, len(comments) - 1, self._outdented(comments, text, indent)), indent)
            elif kind == "restored":
                parent, indent = known[text]
                comments.append(Comment(start, "", indent))
                action_id = f"{rev['rev_id']}.{x}.{places.get(x, x)}"
                action = self._action("RESTORATION", text, action_id, rev, parent, self._reply(comments, len(comments) - 1, indent), indent)
                p.deleted.pop(text, None)
                p.older_deleted.pop(text, None)
            else:
                indent = indentation(text)
                comments.append(Comment(start, "", indent))
                action_id = f"{rev['rev_id']}.{x}.{places.get(x, x)}"
                reply = self._reply(comments, len(comments) - 1, self._outdented(comments, text, indent))
                action = self._action("CREATION" if indent == -1 else "ADDITION", text, action_id, rev, None, reply, indent)
            comments[-1].id = action_id
            out.append(action)
        comments = comments if new else []
        check(new, comments)
        p.text, p.comments, p.rev_id, p.timestamp = new, comments, rev["rev_id"], rev.get("timestamp")
        p.seen += 1
        if p.seen % RELOAD == 0:
            p.older_deleted, p.deleted = p.deleted, {}
        self._prune()

    @staticmethod
    def _outdented(comments: list[Comment], text: str, indent: int) -> int:
        """The indentation that a comment answers from: one that says it is outdented answers the comment before it."""
        return indent + comments[-2].indent + 1 if OUTDENT in text and len(comments) > 1 else indent

    @staticmethod
    def _reply(comments: list[Comment], k: int, indent: int) -> str | None:
        """The nearest earlier comment with a smaller indentation."""
        for c in reversed(comments[:k]):
            if c.indent < indent and c.id:
                return c.id
        return None

    def _prune(self) -> None:
        """Forget lineage of comments that neither stand nor can come back."""
        p = self.page
        alive = {c.id for c in p.comments} | {i for i, _ in [*p.deleted.values(), *p.older_deleted.values()]}
        for known in (p.conversations, p.ancestors, p.authors):
            for i in [i for i in known if i not in alive]:
                del known[i]


class PageFold:
    """Takes the revisions of one page in order, one at a time, until one breaks the page."""

    def __init__(self, page: Page, stop: int | None = None):
        self.page, self.fold, self.stop, self.stopped, self.taken = page, Fold(page), stop, False, set()

    def take(self, rev: dict) -> Iterator[tuple[str, dict]]:
        """(tag, row): the actions of a revision, or the error row at which the page stops. Revisions that the page
        already has, repeated ones, and those from a logged error on are passed over."""
        key = (rev.get("timestamp") or "", rev["rev_id"])
        if self.stopped or rev["rev_id"] in self.taken or key <= (self.page.timestamp or "", self.page.rev_id) or (self.stop is not None and rev["rev_id"] >= self.stop):
            return
        self.taken.add(rev["rev_id"])
        try:
            for action in self.fold.apply(rev):
                yield "action", action
        except AssertionError:
            self.stopped = True
            yield "error", {"page_id": self.page.page_id, "rev_id": rev["rev_id"]}


def fold_page(page: Page, revisions: list[dict]) -> Iterator[tuple[str, dict]]:
    """(tag, row) of one page: actions, then its state, or an error row at which the page stops.

    Revisions are taken by (timestamp, id); those the page already has are passed over.
    """
    fold = PageFold(page)
    for rev in sorted(revisions, key=lambda r: (r.get("timestamp") or "", r["rev_id"])):
        yield from fold.take(rev)
    yield "state", state_row(page)


def state_row(p: Page) -> dict:
    deleted = [{"text": t, "id": i, "indent": n, "older": older} for older, d in ((True, p.older_deleted), (False, p.deleted)) for t, (i, n) in d.items()]
    return {
        "page_id": p.page_id, "page_title": p.title, "rev_id": p.rev_id, "timestamp": p.timestamp, "text": p.text,
        "actions": [{"at": c.start, "id": c.id, "indent": c.indent} for c in p.comments], "deleted": deleted, "conversations": dict(p.conversations),
        "ancestors": dict(p.ancestors), "authors": {i: [{"user_id": a, "user_text": b} for a, b in v] for i, v in p.authors.items()}, "seen": p.seen,
    }


def page_of(row: dict) -> Page:
    pairs = lambda m: dict(m) if m is not None else {}
    deleted = row["deleted"] if row["deleted"] is not None else []
    remembered = lambda older: {d["text"]: (d["id"], int(d["indent"])) for d in deleted if bool(d["older"]) == older}
    return Page(
        row["page_id"], row["page_title"], row["text"] or "", int(row["rev_id"]), row["timestamp"],
        [Comment(int(a["at"]), a["id"], int(a["indent"])) for a in (row["actions"] if row["actions"] is not None else [])],
        remembered(False), remembered(True), pairs(row["conversations"]), pairs(row["ancestors"]),
        {k: [(a["user_id"], a["user_text"]) for a in v] for k, v in pairs(row["authors"]).items()}, int(row["seen"]),
    )


def _output_schema() -> StructType:
    inner = lambda ddl: StructType.fromDDL(ddl)
    return StructType().add("tag", "string").add("action", inner(ACTION)).add("state", inner(PAGE_STATE)).add("error", inner(ERROR))


#: Rows put into one Arrow batch of output.
OUTPUT_ROWS = 500


def tagged(revisions: DataFrame, states: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """(tag, action, state, error): the rows of all three outputs of ``reconstruct`` in one table.

    Revisions and saved states meet by one shuffle on the page and are sorted within it; the fold then reads
    them as a stream, so that a task holds a page's state and a batch of revisions, however long the page.
    Of revisions that share an id the earliest is taken. A page is passed over from its least logged error on.
    """
    rev = "struct<rev_id:bigint,timestamp:string,text:string,user_id:string,user_text:string,page_title:string>"
    fields = ["rev_id", "timestamp", "text", "user_id", "user_text", "page_title"]
    state_type = StructType.fromDDL(PAGE_STATE)
    clean = revisions.withColumn("text", clean_html(F.col("text")))
    news = clean.select(
        "page_id", F.lit(1).alias("kind"), "timestamp", F.col("rev_id").cast("long").alias("rev_id"),
        F.struct(*fields).cast(rev).alias("rev"), F.lit(None).cast(state_type).alias("state"), F.lit(None).cast("long").alias("stop"),
    )
    known = lambda page, kind, state, stop: page.select("page_id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("long").alias("rev_id"), F.lit(None).cast(rev).alias("rev"), state.alias("state"), stop.alias("stop"))
    if states is not None:
        news = news.unionByName(known(states, 0, F.struct(*state_type.names).cast(state_type), F.lit(None).cast("long")))
    if errors is not None:
        least = errors.groupBy("page_id").agg(F.min("rev_id").cast("long").alias("stop"))
        news = news.unionByName(known(least, 0, F.lit(None).cast(state_type), F.col("stop")))
    schema = _output_schema()
    arrow = to_arrow_schema(schema)

    def rows(out: list[tuple[str, dict]]) -> pa.RecordBatch:
        maps = ("conversations", "ancestors", "authors")
        flat = lambda t, r: {**r, **{m: list(r[m].items()) for m in maps}} if t == "state" else r
        return pa.RecordBatch.from_pylist([{"tag": t, "action": None, "state": None, "error": None} | {t: flat(t, r)} for t, r in out], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page_id, state, stop, fold, out = None, None, None, None, []

        def done() -> list[tuple[str, dict]]:
            if fold is not None and (fold.taken or state is not None):
                return [("state", state_row(fold.page))]
            return [("state", state_row(page_of(state)))] if state is not None else []

        for batch in batches:
            for i in range(len(batch)):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                if row["page_id"] != page_id:
                    out += done()
                    page_id, state, stop, fold = row["page_id"], None, None, None
                if row["kind"] == 0:
                    state, stop = row["state"] or state, row["stop"] if row["stop"] is not None else stop
                    continue
                if fold is None:
                    fold = PageFold(page_of(state) if state is not None else Page(page_id), stop)
                out += fold.take(row["rev"])
                if len(out) >= OUTPUT_ROWS:
                    yield rows(out)
                    out = []
        out += done()
        if out:
            yield rows(out)

    by_page = news.where("page_id IS NOT NULL").repartition("page_id").sortWithinPartitions("page_id", "kind", "timestamp", "rev_id", F.xxhash64("rev"))
    return by_page.mapInArrow(run, schema)


def only(kind: str, revisions: DataFrame, states: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """One output of ``reconstruct`` (action, state or error) where the others aren't wanted: nothing is persisted."""
    return tagged(revisions, states, errors).where(F.col("tag") == kind).select(f"{kind}.*")


class Reconstruction(tuple):
    """(actions, states, errors), which share one persisted table until ``close``."""

    shared: DataFrame

    def close(self) -> None:
        self.shared.unpersist()


def reconstruct(revisions: DataFrame, states: DataFrame | None = None, errors: DataFrame | None = None) -> Reconstruction:
    """(actions, states, errors) of all pages, from one pass: see ``tagged``.

    A page without new revisions keeps its state. The three outputs share one persisted table; call
    ``close`` on the result once they are written.
    """
    out = tagged(revisions, states, errors).persist()
    made = Reconstruction(out.where(F.col("tag") == t).select(f"{t}.*") for t in ("action", "state", "error"))
    made.shared = out
    return made


def _revisions(pdf: pd.DataFrame) -> list[dict]:
    return [{k: None if v is None or v != v else v for k, v in r.items()} | {"rev_id": int(r["rev_id"])} for r in pdf.to_dict("records")]


def size_classes(revisions: DataFrame, big_bytes: int = 250 * 1024 * 1024) -> DataFrame:
    """(page_id, n, bytes, size_class, big): pages by their revisions, and whether their texts are very large."""
    n = F.count(F.lit(1))
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    kind = F.when(n < 100, "short").when(n <= 100_000, "long").otherwise("gigantic")
    return revisions.groupBy("page_id").agg(n.alias("n"), size.cast("long").alias("bytes"), kind.alias("size_class"), (size > big_bytes).alias("big"))
