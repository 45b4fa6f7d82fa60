"""Lookups, guards and rates: every row once, each value at its own cost, one rate for all tasks."""

from __future__ import annotations

import time
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.operators import guards
from threadlens.sources import lookups


def test_a_guard_costs_only_its_deadline(spark):
    """One pattern that never ends, one call for too much memory, one error and one death among a thousand texts."""

    def call(text):
        import os
        import re

        if text == "big":
            return str(len(bytearray(3 << 30)))
        if text == "boom":
            raise ValueError("x" * 900)
        if text == "die":
            os._exit(1)
        return str(bool(re.match(r"(a+)+$", text)))

    odd = {3: "a" * 40 + "!", 5: "big", 7: "boom", 9: "die", 11: None}
    df = spark.createDataFrame([(i, odd.get(i, "aaa")) for i in range(1000)], "id long, text string").coalesce(2)
    began = time.time()
    done = guards.guarded(df, "text", call, "string", seconds=1.0, megabytes=200).collect()
    assert time.time() - began < 40
    assert {r.id: r.outcome for r in done if r.outcome != "ok"} == {3: "time", 5: "memory", 7: "error", 9: "died"}
    assert all(r.value == "True" and r.reason is None for r in done if r.id not in odd) and len(done) == 1000
    assert next(r for r in done if r.id == 11).value is None and len(next(r for r in done if r.id == 7).reason) == 500
    kept, errors = guards.cleaned(guards.guarded(df.where("id IN (1, 3, 7)"), "text", call, "string", 1.0, 200), "text")
    assert {r.id: r.value for r in kept.collect()} == {1: "True", 3: odd[3], 7: "boom"}
    assert {(r.id, r.outcome) for r in errors.collect()} == {(3, "time"), (7, "error")} and kept.columns == ["id", "text", "value"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 40), st.integers(0, 20))
def test_allotted(wants, budget, turn):
    shares = guards.allotted(wants, budget, turn)
    assert sum(shares) == min(budget, sum(wants)) and all(0 <= s <= w for s, w in zip(shares, wants, strict=True))
    unmet = [s for s, w in zip(shares, wants, strict=True) if s < w]
    assert not unmet or max(shares) - min(unmet) <= 1


@pytest.mark.parametrize("tasks", [1, 4])
def test_one_rate_for_all_tasks(spark, tasks):
    def call(rows):
        at = time.time()
        return [{"id": r["id"], "at": at} for r in rows]

    got = guards.at_rate(spark.range(60), call, "id long, at double", 10, tasks=tasks, size=2).collect()
    assert sorted(r.id for r in got) == list(range(60))
    calls = sorted({r.at for r in got})
    assert max(sum(x <= y < x + 0.95 for y in calls) for x in calls) <= 10
    assert calls[-1] - calls[0] >= 1.9


@pytest.mark.parametrize("tasks", [1, 4])
def test_a_short_interval_keeps_the_rate(spark, tasks):
    """Tasks that agreed once an interval waited a second each time: 120 calls at 40 a second took 15 s."""

    def call(rows):
        at = time.time()
        return [{"id": r["id"], "at": at} for r in rows]

    got = guards.at_rate(spark.range(120), call, "id long, at double", 40, tasks=tasks, size=1, interval=0.2).collect()
    assert sorted(r.id for r in got) == list(range(120))
    calls = sorted(r.at for r in got)
    assert max(sum(x <= y < x + 0.19 for y in calls) for x in calls) <= 8
    assert 2.7 <= calls[-1] - calls[0] < 8


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(1, 12), st.randoms(use_true_random=False))
def test_the_rate_holds_when_shares_change(left, budget, luck):
    """Tasks that agree at different moments, call after lags of any length and get other shares each time."""
    n, made, turn = len(left), [], 0
    clock, share, begun = [0.0] * n, [budget] * n, [deque(maxlen=budget) for _ in left]
    while any(left):
        wants = [min(w, 2 * budget) for w in left]
        intervals, told = -(-sum(wants) // budget), max(clock)
        before, share = share, guards.allotted([-(-w // intervals) for w in wants], budget, turn)
        for i in range(n):
            agreed = clock[i] = told + luck.choice([0.0, 0.4, 1.0])
            for _ in range(min(wants[i], share[i] * intervals)):
                clock[i] = max(clock[i] + luck.choice([0.0, 0.0, 0.1, 1.3]), guards.due(begun[i], share[i], before[i], agreed, 1.0))
                begun[i].append(clock[i])
                made.append(clock[i])
                left[i] -= 1
        turn += 1
    assert all(sum(x <= y < x + 0.999 for y in made) <= budget for x in made)


def test_paged_lookups_are_taken_up_again(spark, tmp_path):
    """Pages, answers to come back later, a key that fails and a run that dies: every row once, nothing asked for twice after a round is written."""
    folder = tmp_path / "asked"
    folder.mkdir()

    def fetch(key, token):
        import json
        import threading

        page = int(token or 0)
        mark = folder / f"{key}-{page}"
        if key == "3" and page == 1 and not mark.exists():
            mark.write_text("")
            raise lookups.Busy(0.01)
        if key == "5" and page == 2:
            raise OSError("gone")
        if key == "6" and page == 3 and not (folder / "alive").exists():
            import os

            os._exit(1)
        with mark.open("a") as f:
            f.write("x")
        with (folder / f"threads-{os_pid()}").open("a") as f:
            f.write(json.dumps(threading.active_count()) + "\n")
        return [{"n": 10 * page + i} for i in range(2)], None if page >= int(key) else str(page + 1)

    def os_pid():
        import os

        return os.getpid()

    keys = spark.createDataFrame([(str(k % 8),) for k in range(40)] + [(None,)], "k string")
    make = lambda: lookups.PagedLookup(keys, "k", fetch, "n long", str(tmp_path / "rounds"), in_flight=4, pages=2, pause=0.01)
    with pytest.raises(Exception):  # noqa: B017  the worker is lost in the second round
        make()
    (folder / "alive").touch()
    first = {f.name: f.read_text() for f in folder.iterdir() if f.name[0].isdigit() and int(f.name.split("-")[1]) < 2}
    found = make()
    assert sorted((r.key, r.page, r.n) for r in found.rows().collect()) == sorted((str(k), p, 10 * p + i) for k in range(8) for p in range(k + 1) for i in range(2) if not (k == 5 and p >= 2))
    assert [(r.key, r.page, r.error) for r in found.errors().collect()] == [("5", 2, "OSError: gone")]
    assert {n: (folder / n).read_text() for n in first} == first and set(first.values()) == {"x"}
    assert found.rounds == 4
    again = make()
    assert again.rows().count() == found.rows().count() and {n: (folder / n).read_text() for n in first} == first
