"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import stage

#: White space that ends a word: space, and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"

#: Column that carries a whole input row through an operator, whatever its columns are called.
ROW = "_row"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings of the corpus queries: Arrow batches bounded in bytes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row as a struct that no other column can clash with."""
    return docs.select(*names, F.struct("*").alias(ROW))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def give_back() -> None:
    """Return freed memory to the system: workers stay between tasks and share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def power_of_two(at_least: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, at_least)))))


def keep(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for narrow tables, in files of the session's advisory partition size.

    Each file that a task writes costs a few calls to the file system, and each later reader
    a task; without this a table of a few megabytes has as many files as its source.
    """
    return stage(df.hint("rebalance"), name)


# -- words in Arrow ------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts in one array, and where each text's words begin.

    Words are the runs between ``SPACES``; a null text has none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    ends = ends - ends[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), before[ends]


def word_codes(words: pa.Array) -> tuple[np.ndarray, list]:
    """A number per word, and the distinct words in the order of their numbers."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash per word; each distinct word of the batch is hashed once."""
    codes, distinct = word_codes(words)
    table = np.fromiter(
        (xxhash.xxh3_64_intdigest(w.encode(), seed) for w in distinct), np.uint64, len(distinct)
    )
    return table[codes] if len(distinct) else np.zeros(0, np.uint64)


def lower_ascii(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and every other character as it is."""
    return pc.ascii_lower(texts)


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles, and where each text's shingles begin.

    A text with fewer words has its whole word sequence as its only shingle; one without
    words has none. The number of words is part of the hash.
    """
    counts = np.diff(starts)
    shingles = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(begins[-1]) + np.repeat(starts[:-1] - begins[:-1], shingles)
    length = np.repeat(np.minimum(counts, size), shingles)
    h = np.append(hashes, np.zeros(size, np.uint64))
    out = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(size):
        step = mix64(out ^ h[at + i])
        out = np.where(length > i, step, out)
    return out, begins


def in_pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each stay near ``most_bytes``; a longer text is alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // most_bytes
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()
