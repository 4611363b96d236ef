"""A user's own group function, with no group gathered in one task.

The function comes as four parts: ``init()`` makes an empty state, ``update(state, rows)`` takes rows of the group (a ``pyarrow.Table``) into it,
``merge(a, b)`` joins two states and ``finish(state)`` gives the group's output values.  Every task keeps one state per group
it meets and sends on states, not rows, so a group that holds a third of all rows is one state a task.  States are then merged in
two steps, first within ``fan`` parts of a group's tasks and then over the parts.

Defined cases: rows with a null key are a group of their own; a group exists if it has a row; an empty table gives an empty result; ``update`` may see a
group's rows in any order and cut anywhere, so the four parts have to agree for every cut; states are pickled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_STATES = 20_000  # groups a task holds before it sends their states on
FAN = 16


def task_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], init: Callable, update: Callable, max_states: int = MAX_STATES) -> DataFrame:
    """(keys…, _state): the states of each task's groups."""
    keys, columns = list(keys), list(columns)
    narrow = df.select(*keys, *[c for c in columns if c not in keys])
    schema = T.StructType([*[narrow.schema[k] for k in keys], T.StructField("_state", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def out(states: dict) -> pa.RecordBatch:
        rows = [[*k, pickle.dumps(s)] for k, s in states.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows)), arrow)], schema=arrow)

    def body(batches):
        states: dict[tuple, Any] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            groups = t.select(keys).append_column("_at", pa.array(range(t.num_rows))).group_by(keys, use_threads=False).aggregate([("_at", "list")])
            for *key, at in zip(*[groups.column(k).to_pylist() for k in (*keys, "_at_list")]):
                key = tuple(key)
                states[key] = update(states[key] if key in states else init(), t.select(columns).take(pa.array(at)))
            if len(states) > max_states:
                yield out(states)
                states = {}
        if states:
            yield out(states)

    return narrow.mapInArrow(body, schema)


def group_apply(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], init: Callable[[], Any], update: Callable[[Any, pa.Table], Any], merge: Callable[[Any, Any], Any],
    finish: Callable[[Any], dict], schema: str, max_states: int = MAX_STATES, fan: int = FAN,
) -> DataFrame:
    """One row per group: the keys and what ``finish`` returns (``schema`` in DDL)."""
    keys = list(keys)
    states = task_states(df, keys, columns, init, update, max_states).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(fan)))
    key_fields = [states.schema[k] for k in keys]
    held = T.StructType([*key_fields, T.StructField("_state", T.BinaryType())])
    final = T.StructType([*key_fields, *T._parse_datatype_string(schema).fields])
    held_arrow, final_arrow = to_arrow_schema(held), to_arrow_schema(final)

    def merged(rows: pa.Table):
        found = None
        for s in rows.column("_state"):  # one at a time
            s = pickle.loads(s.as_py())
            found = s if found is None else merge(found, s)
        return found

    def one_part(key, rows):
        return pa.Table.from_pylist([{**dict(zip(keys, (k.as_py() for k in key))), "_state": pickle.dumps(merged(rows))}], schema=held_arrow)

    def one_group(key, rows):
        return pa.Table.from_pylist([{**dict(zip(keys, (k.as_py() for k in key))), **finish(merged(rows))}], schema=final_arrow)

    return states.groupBy(*keys, "_part").applyInArrow(one_part, held).groupBy(*keys).applyInArrow(one_group, final)
