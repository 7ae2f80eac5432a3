"""Exact top lists over keys that nobody bounds, such as labels in free text.

A plain count shuffles every key of every task, though only a few can get into the list.
Here each task counts its own rows and stores the counts. Three looks at them follow: the
tasks' own top lists give a lower bound for the last place; a key that can reach it must have
its share of that bound in some task, which leaves few candidates; only these are counted
over all tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.session import scratch_folder, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COUNTED = [
    T.StructField("_task", T.IntegerType()),
    T.StructField("_n", T.LongType()),
    T.StructField("_top", T.BooleanType()),
]
#: Arrow batches that a task counts at a time; what it holds are distinct keys.
_BATCHES = 64


def local_counts(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The keys of each task with their counts there, and whether they are in its top ``k``.

    Nothing is shuffled. A task holds its distinct keys, so no more than its split.
    """
    rows = df.select(*keys)
    schema = T.StructType([*rows.schema.fields, *_COUNTED])
    arrow = to_arrow_schema(schema)

    def merged(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by(keys).aggregate([("_n", "sum")])
        return found.rename_columns([*keys, "_n"] if found.column_names[-1] == "_n_sum" else ["_n", *keys])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table.append_column("_n", pa.array(np.ones(batch.num_rows, np.int64))))
            if len(held) >= _BATCHES:
                held = [merged(held)]
        if not held:
            return
        found = merged(held).select([*keys, "_n"]).combine_chunks()
        n = found.column("_n").to_numpy()
        top = np.zeros(len(n), bool)
        top[np.argsort(-n, kind="stable")[:k]] = True
        task = pa.array(np.full(len(n), TaskContext.get().partitionId(), np.int32))
        out = found.select(keys).append_column("_task", task).append_column("_n", found.column("_n")).append_column("_top", pa.array(top))
        yield from out.cast(arrow).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(count, schema)


def _last_place(counts: DataFrame, n: str, k: int) -> int:
    """The k-th largest of some counts; 0 if there are fewer."""
    best = counts.orderBy(F.desc(n)).limit(k).select(n).collect()
    return best[-1][0] if len(best) == k else 0


def top_keys(df: DataFrame, keys: list[str], k: int, name: str = "count") -> DataFrame:
    """The ``k`` most frequent combinations of ``keys``, most frequent first, ties by the keys.

    Rows with a null key are left out. The result is exact, whatever the number of keys. What
    is shuffled are the tasks' top lists, the counts at or above a task's share of the last
    place's bound, and those of the candidates.
    """
    spark = df.sparkSession
    with scratch_folder(spark, "top") as folder:
        counts = stage(local_counts(df.dropna(subset=keys), keys, k), "counts", folder)
        tasks = counts.select("_task").distinct().count()
        lower = counts.where("_top").groupBy(*keys).agg(F.sum("_n").alias("_n"))
        bound = _last_place(lower, "_n", k)
        share = max(1, -(-bound // max(1, tasks)))
        known = counts.where(F.col("_n") >= share).groupBy(*keys).agg(F.sum("_n").alias("_low"), F.count(F.lit(1)).alias("_told"))
        known = stage(known, "known", folder)
        bound = max(bound, _last_place(known, "_low", k))
        # A task that has not told a key has it less often than the share.
        high = F.col("_low") + (tasks - F.col("_told")) * (share - 1)
        candidates = known.where(high >= bound).select(*keys)
        exact = counts.join(candidates, keys, "left_semi").groupBy(*keys).agg(F.sum("_n").alias(name))
        return stage(exact.orderBy(F.desc(name), *keys).limit(k), "top").orderBy(F.desc(name), *keys)
