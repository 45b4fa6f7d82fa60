"""Replay of a conversation's actions into the comments that stand at its end, for annotators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import clean_snapshot

STANDING = (
    "conversation_id string, id string, content string, user_text string, ts timestamp_ntz, reply_to string, status string, versions array<string>, relative_replyTo int"
)


def replay(actions: list[dict]) -> Iterator[dict]:
    """Comments after all actions, by (time, null first, and the first two id parts as text): each with the ids of its versions.

    A modification keeps its comment's place and, if a bot made it, its author; one whose comment is
    unknown becomes an addition. Removed comments stay with the status removed.
    """
    shown: dict[str, dict] = {}
    key_of: dict[str, str] = {}
    parts = lambda a: (a["id"].split(".") + ["", ""])[:2]
    for a in sorted(actions, key=lambda a: (not pd.isna(a["ts"]), 0 if pd.isna(a["ts"]) else a["ts"], *parts(a))):
        parent = key_of.get(a["parent_id"]) if a["parent_id"] else None
        kind = a["type"]
        if kind == "MODIFICATION" and parent is None:
            kind = "ADDITION"
        if kind in ("ADDITION", "CREATION"):
            key_of[a["id"]] = a["id"]
            shown[a["id"]] = {**a, "status": "added", "versions": [a["id"]]}
        elif parent is not None:
            c = shown[parent]
            key_of[a["id"]] = parent
            c["versions"] = [*c["versions"], a["id"]]
            if kind == "MODIFICATION":
                c["status"], c["content"] = "changed", a["content"]
                if "bot" not in (a["user_text"] or "").lower():
                    c["user_text"] = a["user_text"]
            else:
                c["status"] = "removed" if kind == "DELETION" else "restored"
    place = {v: n for n, c in enumerate(shown.values()) for v in c["versions"]}
    for c in shown.values():
        c["relative_replyTo"] = place.get(c["reply_to"], -1)
        yield c


def snapshots(actions: DataFrame) -> DataFrame:
    """One row for each comment of each conversation: STANDING. A conversation is replayed in one group."""
    rows = actions.select("conversation_id", "id", "type", clean_snapshot(F.coalesce("content", F.lit(""))).alias("content"), "user_text", "ts", "reply_to", "parent_id")
    names = [x.split(" ")[0] for x in STANDING.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        records = [{k: None if v is None or v != v else v for k, v in r.items()} for r in pdf.to_dict("records")]
        return pd.DataFrame([{k: c[k] for k in names} for c in replay(records)], columns=names)

    return rows.withColumn("conversation_id", F.col("conversation_id").cast("string")).groupBy("conversation_id").applyInPandas(run, STANDING)
