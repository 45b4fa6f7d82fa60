"""Schemas of the entities, declared once, and the parts of composite action ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REVISION = (
    "comment string, sha1 string, user_id string, user_text string, user_ip string, timestamp string, text string, format string, "
    "model string, page_id string, page_title string, page_namespace string, rev_id bigint, year int, week int"
)
AUTHOR = "struct<user_id:string,user_text:string>"
#: The sixteen published columns, in order.
ACTION = (
    "id string, type string, content string, cleaned_content string, user_id string, user_text string, timestamp string, parent_id string, "
    "replyTo_id string, indentation int, rev_id bigint, page_id string, page_title string, conversation_id string, ancestor_id string, "
    f"authors array<{AUTHOR}>"
)
PAGE_STATE = (
    "page_id string, page_title string, rev_id bigint, timestamp string, text string, actions array<struct<at:int,id:string,indent:int>>, "
    "deleted array<struct<text:string,id:string,indent:int,older:boolean>>, conversations map<string,string>, ancestors map<string,string>, "
    f"authors map<string,array<{AUTHOR}>>, seen int"
)
ERROR = "page_id string, rev_id bigint"
SCORE = "record_id string, model string, score double"
TALK_NAMESPACES = [1, 3, 5, 7, 9, 11, 13, 15, 101, 109, 119, 447, 711, 829, 2301, 2303]


def id_part(action_id: Column, n: int) -> Column:
    """Part ``n`` (0: revision, 1: new offset, 2: old offset) of an id ``rev.new.old`` as a number; null if it is no such id."""
    return F.when(action_id.rlike(r"^\d+\.\d+\.\d+$"), F.split(action_id, r"\.")[n].cast("long"))


def comment_order(ts: Column, action_id: Column) -> list[Column]:
    """Sort keys of comments: time, then the parts of the id as numbers, then the id as text."""
    return [ts, *(id_part(action_id, n) for n in range(3)), action_id]
