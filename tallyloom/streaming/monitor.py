"""Streaming forms of the monitoring operators."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.functions.exprs import even
from tallyloom.operators import monitor


def daily_counts(results: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Tumbling counts of decisions by project over event time; state is dropped once a window is later than late."""
    stamped = results.withColumn("_ts", F.timestamp_seconds("created_at").cast("timestamp")).withWatermark("_ts", late)
    counts = stamped.groupBy(F.window("_ts", width), "project_id").agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "NOK").alias("nok"))
    return counts.select(F.to_date("window.start").alias("tag"), "project_id", "total", "nok")


def on_alert(results: DataFrame, act: Callable[[list], None], checkpoint: str, above: float = monitor.ALERT_RATE, late: str = "1 day", width: str = "1 day"):
    """Starts a query that calls act with the projects whose NOK rate is above the limit (a row a project and window).

    The rate runs over all results of a window so far, not one micro-batch: the counts are the stream's state. A batch gives act
    the windows that it changed.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rate = even(F.col("nok") / F.col("total") * 100, 1)
        found = rows.withColumn("nok_rate", rate).where(F.col("nok_rate") > above).orderBy("tag", "project_id").collect()
        if found:
            act(found)

    counts = daily_counts(results, late, width)
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def append(results: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends all results to a table; what is newest is a view over it."""
    return results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What each project keeps in the log.
KEPT = 1_000


def after_each(results: DataFrame, above: float = monitor.ALERT_RATE, kept: int = KEPT, idle: str = "7 days", late: str = "1 day") -> DataFrame:
    """After each result, as running_rate() gives it for the whole: total, nok_rate and alarm of its project's day; and gone, the id that it drives out of the newest kept.

    A project's state is its open day's two counts and the newest kept ids with their times, whatever the number of results; a project without results
    for idle loses it. Results of one project count in the order of time within a micro-batch; how the stream is cut into batches changes nothing
    as long as batches follow each other in time. A result of a day that is over counts for its own day from there on anew.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    stamped = results.withColumn("_ts", F.timestamp_seconds("created_at").cast("timestamp")).withWatermark("_ts", late)
    id_type = dict(results.dtypes)["id"]
    out = f"id {id_type}, project_id {dict(results.dtypes)['project_id']}, total long, nok_rate double, alarm boolean, gone {id_type}"
    memory = f"day long, total long, nok long, ids array<{id_type}>, times array<double>"

    def step(key: tuple, parts, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["created_at", "id"], kind="stable")
        day, total, nok, ids, times = state.get if state.exists else (-1, 0, 0, [], [])
        newest = deque(sorted(zip(times, ids)))
        said = []
        for own, at, decision in zip(rows.id.tolist(), rows.created_at.tolist(), rows.decision):
            if at // 86_400 != day:
                day, total, nok = int(at // 86_400), 0, 0
            total, nok = total + 1, nok + (decision == "NOK")
            if newest and (at, own) < newest[-1]:
                newest = deque(sorted([*newest, (at, own)]))
            else:
                newest.append((at, own))
            gone = newest.popleft()[1] if len(newest) > kept else None
            rate = round(nok / total * 100, 1)
            said.append((own, key[0], total, rate, rate > above, gone))
        state.update((day, total, nok, [i for _, i in newest], [t for t, _ in newest]))
        state.setTimeoutTimestamp(int(rows.created_at.max() * 1000) + idle_ms + int(pd.Timedelta(late).total_seconds() * 1000))
        yield pd.DataFrame({c: pd.Series([r[i] for r in said], dtype=object) for i, c in enumerate(("id", "project_id", "total", "nok_rate", "alarm", "gone"))})

    return stamped.select("project_id", "id", "created_at", "decision", "_ts").groupBy("project_id").applyInPandasWithState(step, out, memory, "append", GroupStateTimeout.EventTimeTimeout)
