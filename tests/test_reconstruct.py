"""The page fold: its differences, invariants, resumption, and each kind of action."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.operators import conversations, reconstruct, snapshot, tree
from threadlens.operators.textdiff import apply, diff


def revisions(*texts):
    return [
        {"rev_id": i + 1, "timestamp": f"2001-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "text": t, "user_id": str(i), "user_text": f"u{i}", "page_id": "1", "page_title": "T"}
        for i, t in enumerate(texts)
    ]


def fold(*texts):
    page = reconstruct.Page("1")
    return page, [r for tag, r in reconstruct.fold_page(page, revisions(*texts)) if tag == "action"]


lines = st.lists(st.sampled_from(["== Head ==\n", "One line.\n", ":reply\n", "::more words here\n", "x", "\n", "A B C\n"]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(lines, lines)
def test_differences_cover_both_texts(a, b):
    ops = diff(a, b)
    assert apply(ops, a, b) == b
    assert "".join(a[o.a1 : o.a2] for o in ops if o.name != "insert") == a
    assert all(a[o.a1 : o.a2] == b[o.b1 : o.b2] for o in ops if o.name == "equal")


@settings(max_examples=200, deadline=None)
@given(st.lists(lines, min_size=1, max_size=8))
def test_fold_keeps_its_invariants_and_resumes(texts):
    texts = ["".join(x.strip() + "\n" for x in t.split("\n") if x.strip()) for t in texts]
    page, whole = fold(*texts)
    page.check()
    assert page.text == texts[-1]
    assert len({a["id"] for a in whole}) == len(whole)
    half = len(texts) // 2
    first = reconstruct.Page("1")
    a = [r for t, r in reconstruct.fold_page(first, revisions(*texts)[:half]) if t == "action"]
    second = reconstruct.page_of(reconstruct.state_row(first))
    b = [r for t, r in reconstruct.fold_page(second, revisions(*texts)[half:]) if t == "action"]
    assert a + b == whole


def test_kinds_of_actions():
    head, body, reply = "== Head ==\n", "Hello there.\n", ":A reply to you.\n"
    _, actions = fold(head + body, head + body + reply, head + "Hello there, friend.\n" + reply, head + "Hello there, friend.\n", head + "Hello there, friend.\n" + reply)
    kinds = [a["type"] for a in actions]
    assert kinds == ["CREATION", "ADDITION", "ADDITION", "MODIFICATION", "DELETION", "RESTORATION"]
    by = dict(zip(["c", "a", "r", "m", "d", "s"], actions))
    assert by["r"]["replyTo_id"] == by["a"]["id"] and by["a"]["replyTo_id"] == by["c"]["id"]
    assert {a["conversation_id"] for a in actions} == {by["c"]["id"]}
    assert by["m"]["parent_id"] == by["a"]["id"] and [x["user_text"] for x in by["m"]["authors"]] == ["u0", "u2"]
    assert by["d"]["parent_id"] == by["s"]["parent_id"] == by["r"]["id"]
    assert by["d"]["indentation"] == 1 and by["c"]["indentation"] == -1


def test_a_moved_comment_makes_no_action():
    a, b, c = "== One ==\n", ":the first comment of all\n", "== The second one ==\n"
    page, actions = fold(a + b + c, a + c + b)
    assert [x["type"] for x in actions] == ["CREATION", "ADDITION", "CREATION"]
    assert [k.id for k in page.comments] == [actions[0]["id"], actions[2]["id"], actions[1]["id"]]


def test_short_texts_are_not_restored():
    _, actions = fold("== H ==\n:tiny\n", "== H ==\n", "== H ==\n:tiny\n")
    assert [a["type"] for a in actions][-1] == "ADDITION"


def test_pages_in_spark(spark):
    rnd = random.Random(3)
    rows = []
    for page in range(6):
        text = ""
        for r in range(8):
            text += f"{':' * rnd.randint(0, 2)}comment {page} {r} <b>tag</b>\n"
            rows.append({"rev_id": page * 100 + r, "timestamp": f"2001-01-01T00:00:{r:02d}Z", "text": text, "user_id": None, "user_text": "1.2.3.4", "page_id": str(page), "page_title": "T"})
    schema = "rev_id long, timestamp string, text string, user_id string, user_text string, page_id string, page_title string"
    df = spark.createDataFrame(rows, schema)
    actions, states, errors = reconstruct.reconstruct(df)
    assert actions.count() == 48 and states.count() == 6 and errors.count() == 0
    assert not actions.where("content LIKE '%<b>%'").count()
    early, late = df.where("rev_id % 100 < 4"), df.where("rev_id % 100 >= 4 AND page_id <> '5'")
    first, saved, _ = reconstruct.reconstruct(early)
    then, final, _ = reconstruct.reconstruct(late, saved)
    key = lambda d: sorted(r.id for r in d.collect())
    assert key(first) + key(then) and sorted(key(first) + key(then)) == key(actions.where("page_id <> '5' OR rev_id < 504"))
    assert final.count() == 6  # a page without news keeps its state
    stopped, _, _ = reconstruct.reconstruct(df, errors=spark.createDataFrame([("2", 203)], "page_id string, rev_id long"))
    assert stopped.where("page_id = '2'").count() == 3


def test_snapshots_replay(spark):
    log = [
        {"id": "1.0.0", "type": "CREATION", "content": "h", "user_text": "a", "ts": 1, "reply_to": None, "parent_id": None},
        {"id": "2.0.0", "type": "ADDITION", "content": "x", "user_text": "b", "ts": 2, "reply_to": "1.0.0", "parent_id": None},
        {"id": "3.0.0", "type": "MODIFICATION", "content": "y", "user_text": "fixbot", "ts": 3, "reply_to": "1.0.0", "parent_id": "2.0.0"},
        {"id": "4.0.0", "type": "DELETION", "content": "y", "user_text": "c", "ts": 4, "reply_to": None, "parent_id": "3.0.0"},
        {"id": "5.0.0", "type": "MODIFICATION", "content": "z", "user_text": "c", "ts": 5, "reply_to": "3.0.0", "parent_id": "unknown"},
    ]
    out = list(snapshot.replay(log))
    assert [(c["id"], c["status"], c["content"], c["user_text"], c["relative_replyTo"]) for c in out] == [
        ("1.0.0", "added", "h", "a", -1), ("2.0.0", "removed", "y", "b", 0), ("5.0.0", "added", "z", "c", 1)
    ]
    assert out[1]["versions"] == ["2.0.0", "3.0.0", "4.0.0"]


def test_tree_liveness(spark):
    rows = [
        ("1", "ADDITION", None, 1), ("2", "MODIFICATION", "1", 2), ("3", "ADDITION", None, 3), ("4", "DELETION", "3", 4), ("5", "RESTORATION", "3", 5), ("6", "ADDITION", None, 6), ("7", "DELETION", "6", 7),
    ]
    df = spark.createDataFrame([(i, t, "c", ts, p, None) for i, t, p, ts in rows], "id string, type string, conversation_id string, ts long, parent_id string, reply_to string")
    out = {r.id: (r.present, r.latest) for r in conversations.live_tree(df).collect()}
    assert out == {"1": (False, "2"), "2": (True, "2"), "3": (True, "3"), "6": (False, None)}


def test_a_page_may_be_cut_anywhere():
    """More revisions than the two memories of deleted texts hold: whole or resumed at any cut, the actions are the same."""
    rnd = random.Random(11)
    lines, texts, gone = ["== Head ==\n"], [], []
    for r in range(270):
        if r == 40:
            gone = ["a comment that is gone for long\n"]
            lines.append(gone[0])
        elif r == 62:
            lines.remove(gone[0])
        elif r == 233:
            lines.append(gone[0])
        elif len(lines) > 6 and rnd.random() < 0.4:
            k = rnd.randrange(1, len(lines))
            if lines[k] != "a comment that is gone for long\n":
                gone.append(lines.pop(k))
        elif len(gone) > 3 and rnd.random() < 0.2:
            text = gone.pop(rnd.randrange(1, len(gone)))
            if text not in lines:
                lines.insert(rnd.randrange(1, len(lines) + 1), text)
        else:
            lines.insert(rnd.randrange(1, len(lines) + 1), f"{':' * rnd.randint(0, 3)}comment number {r} of {rnd.randint(0, 9)}\n")
        texts.append("".join(lines))
    _, whole = fold(*texts)
    late = [a for a in whole if a["rev_id"] == 234 and "gone for long" in a["content"]]
    assert [a["type"] for a in late] == ["ADDITION"]
    revs = revisions(*texts)
    for cut in (1, 63, 99, 100, 101, 150, 199, 200, 232, 269):
        first = reconstruct.Page("1")
        a = [r for t, r in reconstruct.fold_page(first, revs[:cut]) if t == "action"]
        b = [r for t, r in reconstruct.fold_page(reconstruct.page_of(reconstruct.state_row(first)), revs[cut:]) if t == "action"]
        assert a + b == whole, cut


def test_a_broken_revision_leaves_the_page(monkeypatch):
    page = reconstruct.Page("1")
    revs = revisions("== H ==\na first comment\n", "== H ==\na first comment\n:a second one here\n", "== H ==\n:a second one here\n")
    check, calls = reconstruct.check, []

    def break_third(text, comments):
        calls.append(text)
        if len(calls) == 3:
            raise AssertionError("broken")
        check(text, comments)

    monkeypatch.setattr(reconstruct, "check", break_third)
    out = list(reconstruct.fold_page(page, revs))
    assert [t for t, _ in out][-2:] == ["error", "state"] and out[-2][1]["rev_id"] == 3
    kept = reconstruct.Page("1")
    monkeypatch.setattr(reconstruct, "check", check)
    before = list(reconstruct.fold_page(kept, revs[:2]))[-1][1]
    assert out[-1][1] == before


def test_outdented_answers():
    _, actions = fold("== H ==\n:one comment\n", "== H ==\n:one comment\n::its answer\n", "== H ==\n:one comment\n::its answer\n[OUTDENT: 2] back at the margin\n")
    by = {a["rev_id"]: a for a in actions if a["type"] == "ADDITION"}
    assert by[3]["indentation"] == 0 and by[3]["replyTo_id"] == by[2]["id"]


def test_errors_and_repeated_revisions(spark):
    rows = [{"rev_id": r, "timestamp": f"2001-01-01T00:00:0{r}Z", "text": "".join(f":line {k} of it\n" for k in range(r + 1)), "user_id": None, "user_text": "u", "page_id": p, "page_title": "T"} for p in ("1", "2") for r in range(6)]
    schema = "rev_id long, timestamp string, text string, user_id string, user_text string, page_id string, page_title string"
    df = spark.createDataFrame([*rows, rows[3], {**rows[4], "timestamp": "2001-01-01T00:00:09Z"}], schema)
    errors = spark.createDataFrame([("2", 4), ("2", 3)], "page_id string, rev_id long")
    made = reconstruct.reconstruct(df, errors=errors)
    actions, states, failed = made
    assert {(r.page_id, r.rev_id) for r in actions.collect()} == {("1", r) for r in range(6)} | {("2", r) for r in range(3)}
    assert actions.count() == 9 and {r.page_id: r.rev_id for r in states.collect()} == {"1": 5, "2": 2} and failed.count() == 0
    made.close()
    then, kept, _ = reconstruct.reconstruct(df.where("page_id = '2'"), states, errors)
    assert then.count() == 0 and {r.page_id: r.rev_id for r in kept.collect()} == {"1": 5, "2": 2}


def tree_of(*rows):
    """(id, type, parent_id, reply_to) in order of time."""
    return {r["id"]: r for r in tree.structure([{"id": i, "type": t, "parent_id": p, "reply_to": a, "_ts": n} for n, (i, t, p, a) in enumerate(rows)])}


def test_trees():
    out = tree_of(("h", "CREATION", None, None), ("a", "ADDITION", None, "h"), ("b", "ADDITION", None, "a"), ("c", "ADDITION", None, "h"))
    assert [(out[i]["parent"], out[i]["depth"], out[i]["dfs_index"]) for i in "habc"] == [(None, 0, 0), ("h", 1, 1), ("a", 2, 2), ("h", 1, 3)]
    assert out["c"]["is_final"] and out["c"]["is_latest"] and out["h"]["is_root"]
    # a changed comment is replaced, and answers to it go to the new version
    out = tree_of(("h", "CREATION", None, None), ("a", "ADDITION", None, "h"), ("m", "MODIFICATION", "a", "h"), ("b", "ADDITION", None, "a"))
    assert not out["a"]["present"] and out["a"]["latest"] == "m" and out["b"]["parent"] == "m" and out["m"]["parent"] == "h" and out["a"]["dfs_index"] is None
    # a changed version that answers what it replaces takes its place
    assert tree_of(("h", "CREATION", None, None), ("a", "ADDITION", None, "h"), ("m", "MODIFICATION", "a", "a"))["m"]["parent"] == "h"
    # a deleted comment's answers go up; once restored they come back
    log = [("h", "CREATION", None, None), ("a", "ADDITION", None, "h"), ("b", "ADDITION", None, "a"), ("d", "DELETION", "a", None)]
    out = tree_of(*log)
    assert "d" not in out and out["a"]["latest"] is None and out["b"]["parent"] == "h"
    out = tree_of(*log, ("r", "RESTORATION", "a", None))
    assert out["a"]["present"] and out["b"]["parent"] == "a" and "r" not in out
    # two starts: the first is the root; an unknown target counts as none
    out = tree_of(("x", "ADDITION", None, None), ("y", "ADDITION", None, None), ("z", "ADDITION", None, "nowhere"))
    assert out["x"]["is_root"] and out["y"]["parent"] == out["z"]["parent"] == "x"
    # answers in a circle: the first of them starts it
    out = tree_of(("x", "ADDITION", None, "y"), ("y", "ADDITION", None, "x"), ("z", "ADDITION", None, "z"))
    assert out["x"]["is_root"] and out["y"]["parent"] == "x" and out["z"]["parent"] == "x"
    assert tree_of(("d", "DELETION", "gone", None)) == {}


def test_deep_threads_and_circles(spark):
    n = 5000
    rows = [(f"{i}.0.0", "1", None if i == 0 else f"{i - 1}.0.0", i) for i in range(n)] + [("a", "2", "b", 1), ("b", "2", "a", 2), ("c", "2", "b", 3)]
    df = spark.createDataFrame(rows, "id string, conversation_id string, reply_to string, t long").selectExpr("id", "conversation_id", "reply_to", "timestamp_seconds(t) AS ts")
    out = {r.id: r for r in conversations.dfs_order(df).collect()}
    assert all(out[f"{i}.0.0"].depth == i == out[f"{i}.0.0"].dfs_index for i in range(n)) and out[f"{n - 1}.0.0"].is_final
    assert {i: out[i].depth for i in "abc"} == {"a": 0, "b": 1, "c": 2}
    assert {r.conversation_id: r.depth for r in conversations.deepest(df).collect()} == {"1": n - 1, "2": 2}
