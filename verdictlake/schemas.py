"""Explicit schemas of the persistent tables and of the records that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _ts = T.StringType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SESSIONS = _table(id=_s, user_id=_s, jira_ticket_id=_s, created_at=_ts)
BDD_FILES = _table(id=_s, session_id=_s, user_id=_s, content=_s, source=_s, created_at=_ts)
CODE_REFERENCE = _table(file=_s, function=_s, line=T.IntegerType())
VERIFICATION_RESULTS = _table(id=_s, session_id=_s, user_id=_s, scenario_id=_s, scenario_title=_s, status=_s, justification=_s, code_reference=CODE_REFERENCE, github_links=T.ArrayType(_s), implementation_suggestion=_s, created_at=_ts)
CHAT_MESSAGES = _table(id=_s, session_id=_s, user_id=_s, role=_s, content=_s, created_at=_ts)

TICKET = _table(ticket_id=_s, summary=_s, description=_s, acceptance_criteria=_s, labels=T.ArrayType(_s), linked_issues=T.ArrayType(_s))
SCENARIO = _table(source_ac_clause=_s, feature=_s, scenario=_s, given=_s, when=_s, then=_s)
FETCHED_FILE = _table(path=_s, content=_s, github_url=_s)
TREE_ENTRY = _table(path=_s, type=_s, size=T.LongType())
PULL_FILE = _table(filename=_s, status=_s, patch=_s)
VERDICT = _table(scenario_id=_s, scenario_title=_s, status=_s, justification=_s, code_reference=CODE_REFERENCE, github_links=T.ArrayType(_s), implementation_suggestion=_s)
#: A stream event is one of verdict, complete, error and log; `type` tells which fields are set.
EVENT = T.StructType([T.StructField("type", _s), *VERDICT.fields, T.StructField("total", T.IntegerType()), T.StructField("passed", T.IntegerType()), T.StructField("failed", T.IntegerType()), T.StructField("message", _s)])
VECTOR = _table(namespace=_s, id=_s, values=T.ArrayType(T.FloatType()), metadata=_table(text=_s, ticket_id=_s))

BDD_SOURCES = ("generated", "uploaded")
STATUSES = ("pass", "fail")
ROLES = ("user", "assistant")
MODES = ("exact_files", "full_repo", "pull_request")
