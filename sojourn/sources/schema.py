"""Trace event schemas and event codes.

Fixed values (must equal the analyzed trace format for right results):
column names, order and types of the task and job event tables, and the
event-type codes.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: task event columns, in file order -------------------------
TASK_EVENT_FIELDS = [
    ("timestamp", T.LongType()),
    ("missing", T.IntegerType()),
    ("jobid", T.LongType()),
    ("taskix", T.LongType()),
    ("machineid", T.LongType()),
    ("evtype", T.IntegerType()),
    ("username", T.StringType()),
    ("sclass", T.IntegerType()),
    ("priority", T.IntegerType()),
    ("cpureq", T.DoubleType()),
    ("ramreq", T.DoubleType()),
    ("hdreq", T.DoubleType()),
    ("constraint", T.IntegerType()),
]

# --- fixed values: job event columns, in file order ---------------------------
JOB_EVENT_FIELDS = [
    ("timestamp", T.LongType()),
    ("missing", T.IntegerType()),
    ("jobid", T.LongType()),
    ("evtype", T.IntegerType()),
    ("username", T.StringType()),
    ("sclass", T.IntegerType()),
    ("jobname", T.StringType()),
    ("logicaljobname", T.StringType()),
]

# job columns that are read but not kept
JOB_DROPPED = ("jobname", "logicaljobname")

# --- fixed values: event types -------------------------------------------------
SUBMIT = 0
SCHEDULE = 1
EVICT = 2
FAIL = 3
FINISH = 4
KILL = 5
LOST = 6
# codes folded into "generalfailure"
GENERAL_FAILURE = (EVICT, FAIL, KILL, LOST)

# lifecycle pivot: output column -> event codes whose timestamp it keeps
LIFECYCLE_COLUMNS = [
    ("arrive", (SUBMIT,)),
    ("schedule", (SCHEDULE,)),
    ("finish", (FINISH,)),
    ("evict", (EVICT,)),
    ("fail", (FAIL,)),
    ("kill", (KILL,)),
    ("lost", (LOST,)),
    ("generalfailure", GENERAL_FAILURE),
]

TASK_META = ["machineid", "username", "sclass", "priority", "cpureq", "ramreq", "hdreq"]
JOB_META = ["username", "sclass"]


def struct_of(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TASK_SCHEMA = struct_of(TASK_EVENT_FIELDS)
JOB_SCHEMA = struct_of(JOB_EVENT_FIELDS)
JOB_SCHEMA_KEPT = struct_of([f for f in JOB_EVENT_FIELDS if f[0] not in JOB_DROPPED])
