"""Character differences of two texts as ordered operations, cut at natural places.

Common lines at both ends are trimmed first, so an edit of a long page costs what its changed middle
costs. The middle is compared by lines, then each replaced run of lines by words; short equalities
between larger changes are absorbed, so that the operations are those a reader would name.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from typing import NamedTuple

_WORD = re.compile(r"\w+|\s|[^\w\s]")


class Op(NamedTuple):
    name: str  # equal, insert or delete
    a1: int
    a2: int
    b1: int
    b2: int


def _common_ends(a: str, b: str) -> tuple[int, int]:
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:  # longest common start, by halving
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    start = lo
    n -= start
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    return start, lo


def _blocks(a: str, b: str, a0: int, b0: int, fine: bool) -> list[Op]:
    """Operations of two texts whose first characters stand at a0 and b0."""
    if not a and not b:
        return []
    if not a:
        return [Op("insert", a0, a0, b0, b0 + len(b))]
    if not b:
        return [Op("delete", a0, a0 + len(a), b0, b0)]
    ua, ub = (_WORD.findall(a), _WORD.findall(b)) if fine else (a.split("\n"), b.split("\n"))
    if not fine:  # each line with its line feed
        ua, ub = ([x + "\n" for x in u[:-1]] + ([u[-1]] if u[-1] else []) for u in (ua, ub))
    pa, pb = [0], [0]
    for x in ua:
        pa.append(pa[-1] + len(x))
    for x in ub:
        pb.append(pb[-1] + len(x))
    out = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, ua, ub, autojunk=False).get_opcodes():
        a1, a2, b1, b2 = a0 + pa[i1], a0 + pa[i2], b0 + pb[j1], b0 + pb[j2]
        if tag == "equal":
            out.append(Op("equal", a1, a2, b1, b2))
        elif tag == "replace" and not fine:
            out += _blocks(a[pa[i1] : pa[i2]], b[pb[j1] : pb[j2]], a1, b1, True)
        else:
            if a2 > a1:
                out.append(Op("delete", a1, a2, b1, b1))
            if b2 > b1:
                out.append(Op("insert", a2, a2, b1, b2))
    return out


def _merged(ops: list[Op], a: str, b: str) -> list[Op]:
    """Equalities no longer than the changes on both their sides become changes; neighbours of one kind join."""
    groups: list[list[int]] = []  # [equal?, a1, a2, b1, b2]
    for op in ops:
        equal = op.name == "equal"
        if groups and groups[-1][0] == equal:
            groups[-1][2], groups[-1][4] = op.a2, op.b2
        else:
            groups.append([equal, op.a1, op.a2, op.b1, op.b2])
    again = True
    while again:
        again = False
        for k in range(1, len(groups) - 1):
            if groups[k][0]:
                size = groups[k][2] - groups[k][1]
                sides = [max(g[2] - g[1], g[4] - g[3]) for g in (groups[k - 1], groups[k + 1])]
                if size <= min(sides) and "\n" not in a[groups[k][1] : groups[k][2]]:
                    groups[k - 1 : k + 2] = [[False, groups[k - 1][1], groups[k + 1][2], groups[k - 1][3], groups[k + 1][4]]]
                    again = True
                    break
    out = []
    for equal, a1, a2, b1, b2 in groups:
        if equal:
            out.append(Op("equal", a1, a2, b1, b2))
        else:
            if a2 > a1:
                out.append(Op("delete", a1, a2, b1, b1))
            if b2 > b1:
                out.append(Op("insert", a2, a2, b1, b2))
    return out


def _to_line_start(op: Op, a: str, b: str) -> Op:
    """Slide an insertion or deletion between equalities back to a line's start, where the texts allow it."""
    text, lo, hi = (b, op.b1, op.b2) if op.name == "insert" else (a, op.a1, op.a2)
    k = 0
    while lo - k > 0 and min(op.a1, op.b1) - k > 0 and not (text[lo - k - 1] == "\n") and text[lo - k - 1] == text[hi - k - 1]:
        k += 1
    if k and (lo - k == 0 or text[lo - k - 1] == "\n"):
        return Op(op.name, op.a1 - k, op.a2 - k, op.b1 - k, op.b2 - k)
    return op


def diff(a: str, b: str) -> list[Op]:
    """Operations that turn ``a`` into ``b``, in order: equal parts cover both texts between the others."""
    if a == b:
        return [Op("equal", 0, len(a), 0, len(b))] if a else []
    start, end = _common_ends(a, b)
    start = a.rfind("\n", 0, start) + 1  # whole lines
    feed = a.find("\n", len(a) - end) if end else -1
    end = 0 if feed < 0 else len(a) - feed - 1
    ops = [Op("equal", 0, start, 0, start)] if start else []
    ops += _blocks(a[start : len(a) - end], b[start : len(b) - end], start, start, False)
    if end:
        ops.append(Op("equal", len(a) - end, len(a), len(b) - end, len(b)))
    ops = _merged(ops, a, b)
    for k, op in enumerate(ops):
        alone = op.name != "equal" and (k == 0 or ops[k - 1].name == "equal") and (k == len(ops) - 1 or ops[k + 1].name == "equal")
        if alone and k:
            slid = _to_line_start(op, a, b)
            shift = op.a1 - slid.a1
            if shift and (k + 1 < len(ops)) and ops[k - 1].a2 - ops[k - 1].a1 >= shift:
                before, after = ops[k - 1], ops[k + 1]
                ops[k - 1] = Op("equal", before.a1, before.a2 - shift, before.b1, before.b2 - shift)
                ops[k], ops[k + 1] = slid, Op("equal", after.a1 - shift, after.a2, after.b1 - shift, after.b2)
    return [o for o in ops if o.a2 > o.a1 or o.b2 > o.b1]


def apply(ops: list[Op], a: str, b: str) -> str:
    return "".join(b[o.b1 : o.b2] for o in ops if o.name != "delete")
