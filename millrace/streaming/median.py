"""The median customer of a name, kept up under inserts and deletes.

The change feed has op ("insert" or "delete") and a customer. A group's customers are its state; every batch that
touches a group puts out its new median, be it an insert or a delete, or nothing when no customer is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.median import KEYS

FEED = "op string, c_w_id int, c_d_id int, c_last string, c_first string, c_id long"
_OUT = "c_w_id int, c_d_id int, c_last string, c_first string, c_id long, changes long"


def _change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, firsts, changes = state.get if state.exists else ([], [], 0)
    here = dict(zip(ids, firsts, strict=True))
    rows = pd.concat(list(batches))
    for op, first, c_id in rows[["op", "c_first", "c_id"]].itertuples(index=False):
        changes += 1
        if op == "insert":
            here[c_id] = first
    for c_id in rows.loc[rows.op == "delete", "c_id"]:  # of one batch, inserts come first
        here.pop(c_id, None)
    order = sorted((first, c_id) for c_id, first in here.items())
    state.update((list(here), list(here.values()), changes))
    first, c_id = order[len(order) // 2] if order else (None, None)
    yield pd.DataFrame({"c_w_id": [key[0]], "c_d_id": [key[1]], "c_last": [key[2]], "c_first": [first], "c_id": pd.array([c_id], "Int64"), "changes": [changes]})


def incremental_median(feed: DataFrame) -> DataFrame:
    """A stream of (keys, c_first, c_id, changes): changes counts the feed's rows of the group so far."""
    return feed.groupBy(*KEYS).applyInPandasWithState(_change, _OUT, "ids array<long>, firsts array<string>, changes long", "update", GroupStateTimeout.NoTimeout)


def latest(put_out: DataFrame) -> DataFrame:
    """The last median of each group that still has one."""
    last = put_out.groupBy(*KEYS).agg(F.max(F.struct("changes", "c_first", "c_id")).alias("m"))
    return last.where("m.c_id is not null").select(*KEYS, "m.c_first", "m.c_id")
