"""Moving rows with long texts: as compressed packets, and once.

A shuffle compresses its blocks in pieces of some 32 KB, which helps texts little. Here a task
gathers the rows it sends to each part and compresses them together (an Arrow stream and
zstd). And where a text is only carried along, as through the join of tickets with labels, it
need not go at all: rows go through the join with a digest in place of the text, and texts and
joined rows meet in the part where the result is wanted. Texts of several rows can also be left
apart for good, stored once each, for rows that name them by a key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART = "_part"
#: Bytes that a task gathers before it sends them.
GATHERED_BYTES = 128 << 20
#: Texts and rows of one part, about. A task holds the texts of its part where they meet.
PART_BYTES = 64 << 20
#: Bytes of one Arrow batch that leaves such a task.
SENT_BYTES = 16 << 20
#: About what a row has beside its text.
ROW_BYTES = 200

_MARK, _PACKET, _SIZE, _BYTES, _GROUP, _SPREAD = "_mark", "_packet", "_packet_size", "_text_bytes", "_group", "_spread"


def _squeezed(table: pa.Table) -> tuple[bytes, int]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    data = sink.getvalue()
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True), data.size


def _unsqueezed(packet: bytes, size: int) -> pa.Table:
    return pa.ipc.open_stream(pa.Codec("zstd").decompress(packet, size)).read_all()


def _folded(table: pa.Table) -> pa.Table:
    """Texts that repeat are held once, however far apart their rows are."""
    for i, field in enumerate(table.schema):
        if pa.types.is_string(field.type) and table.num_rows:
            column = pa.concat_arrays(table.column(i).chunks).dictionary_encode()
            if 2 * len(column.dictionary) <= len(column):
                table = table.set_column(i, field.with_type(column.type), column)
    return table


def _unfolded(table: pa.Table) -> pa.Table:
    for i, field in enumerate(table.schema):
        if pa.types.is_dictionary(field.type):
            kind = field.type.value_type
            table = table.set_column(i, field.with_type(kind), table.column(i).cast(kind))
    return table


def packed(rows: DataFrame, once: str | None = None) -> DataFrame:
    """``_part``, packet and its size: the rows of each task by their ``_part``.

    With ``once`` a packet holds one row for each value of that column.
    """

    def packets(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        parts = table.column(PART).to_numpy()
        order = np.argsort(parts, kind="stable")
        cuts = np.flatnonzero(np.diff(parts[order], prepend=-1))
        table = table.drop_columns([PART])
        for a, b in zip(cuts, np.append(cuts[1:], len(order))):
            at = order[a:b]
            if once:
                values = table.column(once).take(pa.array(at)).to_pylist()
                at = at[sorted({v: i for i, v in enumerate(values)}.values())]
            own = table.take(pa.array(at))
            packet, size = _squeezed(own if once else _folded(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(parts[order[a]])], pa.int32()), pa.array([packet], pa.binary()), pa.array([size], pa.int64())],
                [PART, _PACKET, _SIZE],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GATHERED_BYTES:
                yield from packets(held)
                held, size = [], 0
        if held:
            yield from packets(held)

    return rows.mapInArrow(pack, f"{PART} int, {_PACKET} binary, {_SIZE} bigint")


def sent_to_parts(rows: DataFrame, parts: int) -> DataFrame:
    """All rows in the partition that ``_part`` numbers, in any order, without that column."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet, size in zip(batch.column(_PACKET), batch.column(_SIZE).to_pylist()):
                yield from _unfolded(_unsqueezed(packet.as_buffer(), size)).to_batches()

    sent = packed(rows).repartitionById(parts, F.col(PART))
    return sent.mapInArrow(unpack, T.StructType([f for f in rows.schema.fields if f.name != PART]))


# -- texts that rows leave behind ----------------------------------------------------


def _mark(text: str) -> Column:
    # Half a SHA-256: unequal texts do not share it, not on purpose either.
    return F.substring(F.unhex(F.sha2(F.col(text).cast("binary"), 256)), 1, 16)


def _filled(schema: T.StructType, text: str) -> Callable:
    """Give the rows of a partition the texts that its packets hold."""
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, places, book, lengths = [], {}, None, None
        for batch in batches:
            is_packet = pc.is_valid(batch.column(_PACKET))
            for packet, size in zip(batch.column(_PACKET).filter(is_packet), batch.column(_SIZE).filter(is_packet).to_pylist()):
                table = _unsqueezed(packet.as_buffer(), size)
                marks = table.column(_MARK).to_pylist()
                new = [i for i, mark in enumerate(marks) if mark not in places]
                places.update((marks[i], len(places)) for i in new)
                found += table.column(text).take(pa.array(new, pa.int64())).cast(pa.large_string()).chunks
            rows = batch.filter(pc.invert(is_packet))
            if not rows.num_rows:
                continue
            if book is None:
                # All packets come before the first row.
                book = pa.concat_arrays([pa.array([], pa.large_string()), *found])
                lengths, found = np.append(pc.binary_length(book).to_numpy(), 0), []
            at = np.array([-1 if m is None else places[m] for m in rows.column(_MARK).to_pylist()], np.int64)
            begins = np.flatnonzero(np.diff(np.cumsum(ROW_BYTES + lengths[at]) // SENT_BYTES, prepend=-1))
            for a, b in zip(begins, np.append(begins[1:], len(at))):
                own = book.take(pa.array(at[a:b], mask=at[a:b] < 0)).cast(pa.string())
                part = rows.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own if n == text else part.column(n) for n in names], schema=arrow)

    return fill


def _marked(df: DataFrame, text: str, group: Column | None, folder: str | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with a digest of its texts, and its stored rows without them."""
    label = F.coalesce((F.lit(None) if group is None else group).cast("string"), F.lit(""))
    marked = df.withColumns({_MARK: _mark(text), _BYTES: F.coalesce(F.octet_length(text), F.lit(0)), _GROUP: label})
    rest = [c for c in df.columns if c != text]
    narrow = marked.select(*rest, _MARK, _BYTES, _GROUP, F.xxhash64(_MARK, *rest).alias(_SPREAD))
    return marked, stage(narrow, "narrow", folder)


def _through(narrow: DataFrame, kept: list[str], through: Callable[[DataFrame], DataFrame], text: str) -> tuple[DataFrame, list[str]]:
    """What ``through`` makes of rows without texts, and the columns it shows."""
    absent = F.lit(None).cast("string").alias(text)
    joined = through(narrow.select(*[absent if c == text else c for c in kept], _MARK, _BYTES, _GROUP, _SPREAD))
    return joined, [c for c in joined.columns if c not in (_MARK, _BYTES, _GROUP, _SPREAD)]


def _met(rows: DataFrame, texts: DataFrame, parts: int, out: T.StructType, text: str) -> DataFrame:
    """Rows and the texts of their marks, in the partitions that ``_part`` numbers on both sides."""
    both = rows.unionByName(packed(texts, once=_MARK), allowMissingColumns=True)
    # Packets first; rows with one text follow each other, so that files hold it in little more than its own size.
    met = both.repartitionById(parts, F.col(PART)).sortWithinPartitions(F.col(_PACKET).isNull(), _MARK)
    return met.mapInArrow(_filled(out, text), out)


def without_text(
    df: DataFrame, through: Callable[[DataFrame], DataFrame], text: str, group: Column | None = None, folder: str | None = None
) -> DataFrame:
    """``through(df)``, which only carries the column ``text`` along, without moving it for that.

    ``through`` gets the rows with some columns more, in place of their texts, and may drop
    or repeat rows and change the others, but has to keep these columns. Rows of one ``group``
    (an expression of the columns of ``df``) lie together in the result, large groups in
    several partitions. ``df`` is read twice and has to give the same rows. A text is sent
    once by each task to each part that needs it.
    """
    marked, narrow = _marked(df, text, group, folder)
    joined, shown = _through(narrow, df.columns, through, text)
    return _carried(marked, narrow, joined, shown, text)


def _carried(marked: DataFrame, narrow: DataFrame, joined: DataFrame, shown: list[str], text: str) -> DataFrame:
    spark = marked.sparkSession
    # One row per group.
    sizes = narrow.groupBy(_GROUP).agg(F.sum(F.col(_BYTES) + ROW_BYTES).alias("n")).orderBy(_GROUP).collect()
    places, at = [], 0
    for row in sizes:
        split = max(1, round(row["n"] / PART_BYTES))
        first = -(-at // PART_BYTES) if split > 1 else at // PART_BYTES
        places.append((row[_GROUP], first, split))
        at = max(at + row["n"], (first + split) * PART_BYTES if split > 1 else 0)
    parts = max((first + split for _, first, split in places), default=1)
    known = F.broadcast(spark.createDataFrame(places, f"{_GROUP} string, _first int, _split int"))
    # Rows without a text go anywhere in their group.
    turn = F.when(F.col(_MARK).isNull(), F.col(_SPREAD)).otherwise(F.xxhash64(_MARK))
    part = (F.col("_first") + F.pmod(turn, F.col("_split"))).cast("int").alias(PART)

    out = joined.select(*shown).schema
    rows = joined.join(known, _GROUP).select(*[c for c in shown if c != text], _MARK, part)
    texts = marked.where(F.col(_MARK).isNotNull()).withColumn(_SPREAD, F.lit(0)).join(known, _GROUP).select(_MARK, text, part)
    return _met(rows, texts, parts, out, text)


# -- texts of several rows, stored once ----------------------------------------------

#: Column by which rows find a text that is stored once for all of them; null where rows hold their own.
TEXT_KEY = "text_key"
#: Column of a text store: the newest group of rows that uses a text.
TEXT_GROUP = "text_month"
#: Rows that find their text under one key, about: a text of more rows has several keys, so that no join has a hot one.
ROWS_PER_KEY = 100_000
#: Texts are stored once if the texts of all rows have this many times the bytes of the unequal ones.
WORTH_SHARING = 1.5


def text_apart(
    df: DataFrame, through: Callable[[DataFrame], DataFrame], text: str, group: Column, folder: str | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``without_text``, with texts of several rows left apart: the rows, and the texts that they name.

    The rows have ``TEXT_KEY`` and no text, in any order; the texts are (``TEXT_KEY``, ``text``, ``TEXT_GROUP``),
    one row per unequal text (per key of it, if more than ``ROWS_PER_KEY`` rows have it), with the greatest group
    (a date) of its rows, and lie together by it. Where few texts are equal this saves little and costs
    readers a join: there the rows come with their own texts as from ``without_text``, and no others.
    """
    marked, narrow = _marked(df, text, group, folder)
    # One narrow row for each unequal text.
    found = narrow.where(F.col(_MARK).isNotNull()).groupBy(_MARK)
    found = found.agg(F.count(F.lit(1)).alias("_n"), F.max(_BYTES).alias("_b"), F.max(_GROUP).alias("_newest"))
    found = stage(found, "marks", folder)
    once, held = found.agg(F.sum("_b"), F.sum(F.col("_b") * F.col("_n"))).head()
    if not once or held < WORTH_SHARING * once:
        joined, shown = _through(narrow, df.columns, through, text)
        return _carried(marked, narrow, joined, shown, text), None
    hot = found.where(F.col("_n") > ROWS_PER_KEY).select(F.col(_MARK).alias("_hot"), F.ceil(F.col("_n") / ROWS_PER_KEY).alias("_keys"))
    # One row per ``ROWS_PER_KEY`` rows, at most.
    hot = F.broadcast(hot) if not hot.isEmpty() else hot.limit(0)

    def keyed(rows: DataFrame, copy: Callable[[Column], Column], *columns) -> DataFrame:
        suffix = F.unhex(F.lpad(F.hex("_copy"), 8, "0"))
        key = F.when(F.col("_keys").isNull(), F.col(_MARK)).otherwise(F.concat(_MARK, suffix)).alias(TEXT_KEY)
        dealt = rows.join(hot, F.col(_MARK) == F.col("_hot"), "left").withColumn("_copy", copy(F.coalesce("_keys", F.lit(1))))
        return dealt.select(*columns, key)

    joined, shown = _through(narrow, df.columns, through, text)
    rows = keyed(joined, lambda keys: F.pmod(F.col(_SPREAD), keys).cast("bigint"), *shown)

    parts = max(1, round(once / PART_BYTES))
    part = F.pmod(F.xxhash64(_MARK), F.lit(parts)).cast("int").alias(PART)
    newest = F.when(F.col("_newest") != "", F.col("_newest")).cast("date").alias(TEXT_GROUP)
    entries = keyed(found, lambda keys: F.explode(F.sequence(F.lit(0).cast("bigint"), keys - 1)), newest, _MARK, part)
    texts = marked.where(F.col(_MARK).isNotNull()).select(_MARK, text, part)
    out = T.StructType(
        [T.StructField(TEXT_KEY, T.BinaryType()), T.StructField(text, T.StringType()), T.StructField(TEXT_GROUP, T.DateType())]
    )
    return rows, _met(entries, texts, parts, out, text).hint("rebalance", F.col(TEXT_GROUP))
