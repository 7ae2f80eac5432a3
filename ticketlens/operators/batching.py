"""Numbering tickets and cutting them into batches."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.operators.packed_texts import PART, sent_to_parts, without_text
from ticketlens.session import stage

BATCH_SIZE = 20

#: ``monotonically_increasing_id`` keeps the partition number above this bit.
_ROW_BITS = 33


def break_ties(df: DataFrame, order_by: str) -> tuple[DataFrame, list[str]]:
    """Add two columns that tell rows with the same order value apart.

    They are a hash of the whole row and, for equal copies, the place in the sorted
    input partition (sorted, so that a task that runs again numbers its copies the
    same). Ordering by the returned columns, ranges can split any group of equal
    values, and of equal rows, however large.
    """
    tied = (
        df.withColumn("_tie", F.xxhash64(*df.columns))
        .sortWithinPartitions(order_by, "_tie")
        .withColumn("_copy", F.monotonically_increasing_id())
    )
    return tied, [order_by, "_tie", "_copy"]


def place_rows(df: DataFrame, order_by: str, folder: str | None = None) -> DataFrame:
    """Split rows by range, sort each range, and store every row's ``_range`` and ``_place``."""
    kept = df.columns
    tied, ordering = break_ties(df, order_by)
    placed = (
        tied.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .select(*kept, F.monotonically_increasing_id().alias("_place"))
    )
    return stage(placed, "placed", folder).select(
        *kept,
        F.shiftright("_place", _ROW_BITS).alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_place"),
    )


def number_rows(
    df: DataFrame, order_by: str, number: str = "row_no", folder: str | None = None
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of a column, in parallel.

    The stored ranges and places are fixed, so nothing depends on a plan running
    twice in the same way. A running sum over the sizes of the ranges, one row per
    range, turns places into global numbers.
    """
    placed = place_rows(df, order_by, folder)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # One row per range of the shuffle above: bounded by its partition count.
    numbered = placed.join(F.broadcast(starts), "_range")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place")).alias(number))


# -- numbering with one exchange of whole rows ---------------------------------------


#: Cells of a part of rows with long texts, and of all parts, at most.
CELLS_PER_PART, MOST_CELLS = 16, 8192
#: Texts that a cell is known by, at most, and of which share of all texts they are taken.
SKETCH, SKETCHED = 32, 8


@dataclass(frozen=True)
class _Bounds:
    """Where rows ``rows_per_cell``, 2 x ``rows_per_cell``, ... begin, by key.

    ``starts`` are (key, cell): rows from this key on belong to the cell. ``cut`` are keys whose
    equal rows lie in several cells: (key, cell, copies). ``groups`` are the cells of each part.
    """

    rows_per_cell: int
    starts: list[tuple[tuple, int]]
    cut: list[tuple[tuple, int, int]]
    groups: list[list[int]]

    @property
    def part_of(self) -> list[int]:
        """The part of every cell."""
        return [part for _, part in sorted((cell, part) for part, group in enumerate(self.groups) for cell in group)]


_TIES = ["_tie1", "_tie2"]


def tie_columns(columns: list[str]) -> dict[str, Column]:
    """Two columns that tell rows with unequal ``columns`` apart: a 128-bit hash."""
    return {tie: F.xxhash64(F.lit(seed), *columns) for seed, tie in enumerate(_TIES)}


def _sketched(text: str) -> Column:
    """A hash of some texts, the same ones wherever they are; null for the others."""
    mark = F.xxhash64(text)
    return F.when(F.col(text).isNotNull() & (F.pmod(mark, F.lit(SKETCHED)) == 0), mark)


def _grouped(cells: int, parts: int, sketches: dict[int, list[int]]) -> list[list[int]]:
    """Deal cells to parts, equally many to each, so that cells with the same texts meet.

    A part begins with the first cell that is left and takes the one that shares most with what it
    has, or else the next in order.
    """
    most, holders = -(-cells // parts), defaultdict(list)
    for cell, marks in sketches.items():
        for mark in marks:
            holders[mark].append(cell)
    shared_by = {mark: np.array(found) for mark, found in holders.items() if len(found) > 1}
    left, groups = np.ones(cells, bool), []
    while left.any():
        cell, group, known, shared = int(left.argmax()), [], set(), np.zeros(cells, np.int64)
        while True:
            group.append(cell)
            left[cell] = False
            if len(group) == most or not left.any():
                break
            new = {mark for mark in sketches.get(cell, ()) if mark in shared_by} - known
            for mark in new:
                shared[shared_by[mark]] += 1
            known |= new
            cell = int(np.where(left, shared, -1).argmax())
        groups.append(sorted(group))
    return groups


def _find_bounds(
    keyed: DataFrame, key: list[str], unit: int, parts: int, folder: str | None, unique: bool = False, text: str | None = None
) -> _Bounds | None:
    """Bounds at exact row numbers, from the keys and their counts alone; none if ``unique`` keys repeat.

    Equal keys are counted in each task first, so a key of a third of all rows is one narrow
    row. The driver gets one row per bound. With ``text`` there are more cells than parts, and those
    that hold the same texts are dealt to the same part, for which the driver gets up to ``SKETCH`` hashes a cell.
    """
    wanted = parts * (min(CELLS_PER_PART, max(1, MOST_CELLS // parts)) if text and parts > 1 else 1)
    counts = [F.count(F.lit(1)).alias("_n")] + ([F.min(_sketched(text)).alias("_sketch")] if wanted > parts else [])
    groups = stage(keyed.groupBy(*key).agg(*counts), f"keys{len(key)}", folder)
    total, most = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.max("_n")).head()
    rows = max(1, -(-total // (wanted * unit))) * unit
    if total <= rows:
        return _Bounds(rows, [], [], [[0]])
    if unique and most > 1:
        return None
    placed = stage(
        groups.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()),
        f"ordered_keys{len(key)}",
        folder,
    ).withColumn("_range", F.shiftright("_at", _ROW_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.sum("_n").alias("_rows"))
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    if most > 1:
        inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        place = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    # One row per range of the shuffle above: bounded by its partition count.
    counted = placed.withColumn("_place", place).join(F.broadcast(starts), "_range")
    first, stop = F.col("_start") + F.col("_place"), F.col("_start") + F.col("_place") + F.col("_n")
    holds_bound = F.expr(f"(_stop - 1) DIV {rows} > (_first - 1) DIV {rows}")
    counted = counted.withColumns({"_first": first, "_stop": stop})
    found = (
        counted.where(holds_bound)
        .select(F.struct(*key).alias("key"), "_first", "_stop")
        .orderBy("_first")
        .collect()
    )
    starts_at, cut = [], []
    for row in found:
        start, end = row["_first"], row["_stop"]
        starts_at.append((tuple(row["key"]), (end - 1) // rows))
        if start // rows != (end - 1) // rows:
            for cell in range(start // rows, (end - 1) // rows + 1):
                copies = min(end, (cell + 1) * rows) - max(start, cell * rows)
                cut.append((tuple(row["key"]), cell, copies))
    cells, sketches = -(-total // rows), {}
    if cells > parts and wanted > parts:
        told = counted.where(F.col("_sketch").isNotNull()).groupBy(F.expr(f"_first DIV {rows}").alias("_cell"))
        least = F.slice(F.sort_array(F.collect_set("_sketch")), 1, SKETCH)
        sketches = {row["_cell"]: row["_marks"] for row in told.agg(least.alias("_marks")).collect()}
    return _Bounds(rows, starts_at, cut, _grouped(cells, parts, sketches))


def _listed(values: list) -> Column:
    """An array of whole numbers, or of such arrays, as a literal."""
    return F.expr(str(values).replace("[", "array(").replace("]", ")"))


def _with_part(keyed: DataFrame, key: list[str], bounds: _Bounds) -> DataFrame:
    """Add the ``_part`` of a row's cell, that of the last start at or before its key, found in three steps."""
    if not bounds.starts:
        return keyed.withColumn(PART, F.lit(0))
    step = max(1, round(len(bounds.starts) ** (1 / 3)))

    def pages(entries: list, size: int) -> list[list]:
        return [entries[i : i + size] for i in range(0, len(entries), size)]

    own = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    fields = [list(map(F.lit, values)) for values in zip(*[start for start, _ in bounds.starts])]
    keys = fields[0] if len(key) == 1 else [F.struct(*[f.alias(c) for c, f in zip(key, start)]) for start in zip(*fields)]
    shelves = pages(pages(keys, step), step)
    firsts = F.array(*[shelf[0][0] for shelf in shelves])
    middle = F.array(*[F.array(*[page[0] for page in shelf]) for shelf in shelves])
    whole = F.array(*[F.array(*[F.array(*page) for page in shelf]) for shelf in shelves])

    def last(found: Column) -> Column:
        return F.size(F.filter(found, lambda k: k <= own)) - 1

    # Before the first start, the first step finds -1 and the others null.
    part_of = bounds.part_of
    parts = _listed([part_of[cell] for _, cell in bounds.starts])
    at = F.col("_at0") * (step * step) + F.col("_at1") * step + F.col("_at2")
    return (
        keyed.withColumn("_at0", last(firsts))
        .withColumn("_at1", last(F.get(middle, F.col("_at0"))))
        .withColumn("_at2", last(F.get(F.get(whole, F.col("_at0")), F.col("_at1"))))
        .withColumn(PART, F.when(F.col("_at0") < 0, part_of[0]).otherwise(F.get(parts, at)))
        .drop("_at0", "_at1", "_at2")
    )


def number_in_order(
    df: DataFrame,
    order_by: str,
    number: str = "row_no",
    unit: int = 1,
    parts: int | None = None,
    folder: str | None = None,
    text: str | None = None,
    columns: list[str] | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Number all rows 0, 1, 2, ... in the order of a column; whole rows move once.

    The keys alone are sorted and stored first, which tells at which keys the parts begin.
    Parts hold equally many rows, a multiple of ``unit``, so that each part's numbers are known
    before its rows arrive; the rows then go straight to their part and are sorted there. The
    result is in order within partitions, and no run of ``unit`` rows is split between them.

    Where values repeat, rows are ordered by a 128-bit hash of the whole row, too (by the columns
    ``ties``, if given, which have to tell unequal rows apart); else the first step reads the one column only. Equal rows that lie across a bound are sent once to
    each part they reach, with their count there. Rows with a column ``text`` move as compressed
    packets (``packed_texts``), and a part may be several runs of rows that share texts, since a packet
    holds a text once; texts are hashed with the keys for that. Of ``columns``, with ``order_by`` among them, the result is made if
    given; others are not moved, but rows with equal values are still ordered by all columns.
    ``df`` is read twice and has to give the same rows; values must not be null. ``parts`` is the number of shuffle partitions if not given.
    """
    spark, kept = df.sparkSession, df.columns
    shown = columns or kept
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, keyed = [order_by], df
    shared = text if text in shown else None
    bounds = _find_bounds(keyed, key, unit, parts, folder, unique=True, text=shared)
    if bounds is None:
        key = [order_by, *(ties or _TIES)]
        keyed = df if ties else df.withColumns(tie_columns(kept))
        bounds = _find_bounds(keyed, key, unit, parts, folder, text=shared)
    rows = _with_part(keyed, key, bounds)
    if bounds.cut:
        fields = keyed.select(*key).schema.fields
        schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_copies", T.LongType())])
        pieces = F.broadcast(spark.createDataFrame([(*k, bounds.part_of[cell], copies) for k, cell, copies in bounds.cut], schema))
        keys = pieces.select(*key).distinct()
        once = keyed.join(keys, key, "left_semi").groupBy(*key).agg(F.first(F.struct(*kept)).alias("_row"))
        copied = once.join(pieces, key).select("_row.*", *[c for c in key if c not in kept], "_part", "_copies")
        whole = rows.join(keys, key, "left_anti").withColumn("_copies", F.lit(1).cast("bigint"))
        rows = whole.unionByName(copied)
    rows = rows.drop(*[c for c in kept if c not in shown])
    # Of equal keys only equal rows are left, which nothing tells apart.
    sent = sent_to_parts(rows, len(bounds.groups)) if text else rows.repartitionById(len(bounds.groups), F.col(PART))
    sent = sent.sortWithinPartitions(*key)
    if bounds.cut:
        sent = sent.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
    # All cells are full but the last of all, which ends its part.
    placed = sent.select(*shown, F.monotonically_increasing_id().alias("_at")).select(
        *shown,
        F.get(_listed(bounds.groups), F.shiftright("_at", _ROW_BITS).cast("int")).alias("_cells"),
        F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_place"),
    )
    size = F.lit(bounds.rows_per_cell)
    first = F.get("_cells", F.floor(F.col("_place") / size).cast("int")).cast("bigint") * size
    return placed.select(*shown, (first + F.pmod("_place", size)).alias(number))


def assign_batches(
    tickets: DataFrame,
    batch_size: int = BATCH_SIZE,
    order_by: str = "ticket_id",
    folder: str | None = None,
    parts: int | None = None,
    columns: list[str] | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos`` (both from 0), by ticket order.

    The rows of a batch follow each other in one partition. Tickets without an id cannot be
    matched to an answer and are left out. With ``columns`` only these are moved and returned.
    ``ties`` are as in ``number_in_order``.
    """
    with_id = tickets.where(F.col(order_by).isNotNull())
    text = "ticket_body" if "ticket_body" in tickets.columns else None
    numbered = number_in_order(with_id, order_by, "_row_no", batch_size, parts, folder, text, columns, ties)
    return numbered.select(
        *(columns or tickets.columns),
        F.expr(f"_row_no DIV {int(batch_size)}").alias("batch_id"),
        F.pmod("_row_no", F.lit(batch_size)).cast("int").alias("batch_pos"),
    )


def assign_batches_apart(tickets: DataFrame, text: str, batch_size: int = BATCH_SIZE, order_by: str = "ticket_id") -> DataFrame:
    """``assign_batches`` for readers of single tickets: the same batches, but rows with equal texts lie together.

    A text takes no part in the order, beyond the hash that tells tickets of one id apart. So the
    tickets are numbered without their texts, which meet them afterwards (``without_text``).
    """
    with_id = tickets.where(F.col(order_by).isNotNull())
    tied = with_id.withColumns(tie_columns(tickets.columns))

    def numbered(rows: DataFrame) -> DataFrame:
        absent = F.lit(None).cast("string").alias(text)
        batched = assign_batches(rows.drop(text), batch_size, order_by, ties=_TIES)
        return batched.select("*", absent).drop(*_TIES)

    out = without_text(tied, numbered, text)
    return out.select(*tickets.columns, "batch_id", "batch_pos")
