"""Best-fit packing with bound-certified repacking.

Documents are tokenised once, cut into pieces and dealt to partitions, which pack their
pieces by best-fit decreasing. Lower bounds from dual feasible functions say how many
sequences a partition needs at least; one that uses no more is certified and stays as it
is. The others exchange their pieces: these are dealt anew and packed again, in several
orders, until all are certified or a round saves no sequence. What dealing alone leaves, the
emptiest sequence of each partition, is packed together last, if that saves sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import in_pieces, keep, split_words, whole_text, word_codes

CAPACITY = 4096
END_ID = 1
#: Pieces per partition, about; bounds what one packing task holds (narrow rows).
PARTITION_PIECES = 40_000
#: How far from decreasing order packing again strays, one try each.
SPREADS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 30.0, 30.0)
#: Stands between words while they are encoded; a token of its own.
_BETWEEN = "\x01"
#: Words that stay one piece as they are; their bytes beyond ASCII stand for characters that
#: the vocabulary writes them with: printable Latin-1 as it is, others counted up from 256.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Distinct words whose ids a task remembers; beyond it starts anew.
REMEMBERED_WORDS = 600_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordTokenizer:
    """Token ids of texts, from the ids of their distinct words.

    The vocabulary ignores case, drops white space and never joins tokens across it, nor
    across a plain small letter and a following punctuation mark. So a text's ids are those of its words
    in a row, and marks can be cut off and A-Z be lowered first. Only texts that hold the
    start of a special token, which is matched as written, keep their case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        (self.between,) = self._encode(_BETWEEN)
        self._forget()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _letters(self, word: str) -> list[int]:
        """Ids of a word of plain small letters: one piece, ready for the merges."""
        data = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(data)]

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if _LETTERS.fullmatch(w)]
        coded = [self._letters(w) for w in letters]
        ids = [np.fromiter((i for c in coded for i in c), np.uint32)]
        sizes = [np.fromiter(map(len, coded), np.int64, len(coded))]
        mixed = [w for w in words if _BETWEEN not in w and not _LETTERS.fullmatch(w)]
        for at in range(0, len(mixed), 512):
            found = np.array(self._encode(f" {_BETWEEN} ".join(mixed[at : at + 512])), np.uint32)
            marks = np.flatnonzero(found == self.between)
            ids.append(np.delete(found, marks))
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(found)]])) - 1)
        odd = [w for w in words if _BETWEEN in w]
        for w in odd:
            found = self._encode(w)
            ids.append(np.array(found, np.uint32))
            sizes.append(np.array([len(found)]))
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size) - size
        self.known.update(zip([*letters, *mixed, *odd], range(len(self.size), len(self.size) + len(words))))
        self.ids = np.concatenate([self.ids, *ids])
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin."""
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words, starts = split_words(pc.replace_substring_regex(texts, r"([a-zß-öø-ÿ])([.,;:!?#$%&*])", r"\1 \2"))
        codes, distinct = word_codes(words)
        if len(self.known) > REMEMBERED_WORDS:
            self._forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        word = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[codes]
        size = self.size[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begin[word] - ends[:-1], size) + np.arange(ends[-1])
        return self.ids[at], ends[starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, number, start, length and checksum of its token ids.

    A document is its ids and then ``END_ID``; an empty or null text is the end id alone.
    ``tokenizer`` is the path of a vocabulary file that every executor has.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        for batch in in_pieces(batches, "text"):
            ids, begins = coder.encode(batch.column("text"))
            rows: list[tuple] = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), begins[:-1], begins[1:]):
                full = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                for number, start in enumerate(range(0, len(full), capacity)):
                    part = full[start : start + capacity]
                    rows.append((doc_id, number, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(cut, PIECES)


# -- packing of one partition --------------------------------------------------------


def best_fit_decreasing(
    lengths: np.ndarray, capacity: int = CAPACITY, order: np.ndarray | None = None
) -> np.ndarray:
    """The bin of each item: longest first, into the fullest bin that still has room.

    ``order`` takes the items in another order.
    """
    order = np.argsort(-lengths, kind="stable") if order is None else order
    bins = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    rooms, opened = 0, 0  # bit r of rooms: some bin has room r
    for i in order:
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[i] = chosen
        left = room - length
        if left:
            with_room[left].append(chosen)
            rooms |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    The first drops items up to a threshold and rounds those above its complement up to a
    whole bin; the second rounds sizes to multiples of 1/(k+1). Whatever fits one bin has
    function values of at most one bin in sum, so the sum over all items is a bound.
    """
    if not len(lengths):
        return 0
    size, count = np.unique(lengths, return_counts=True)
    best = -(-int((size * count).sum()) // capacity)
    for low in np.concatenate([[0], size[2 * size <= capacity]]):
        value = np.where(size > capacity - low, capacity, np.where(size >= low, size, 0))
        best = max(best, -(-int((value * count).sum()) // capacity))
    for k in range(1, 50):
        whole = (k + 1) * size % capacity == 0
        # In units of 1 / (capacity * k): exact sizes stay, others fall to floor((k+1)x)/k.
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (capacity * k)))
    return best


def best_of_orders(lengths: np.ndarray, bound: int, seed: int, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item by best fit, in orders of growing disorder until the bound is met."""
    best = best_fit_decreasing(lengths, capacity)
    draw = np.random.default_rng(seed)
    for spread in SPREADS:
        if best.max() < bound:
            break
        order = np.argsort(-lengths * (1 + spread * draw.random(len(lengths))), kind="stable")
        found = best_fit_decreasing(lengths, capacity, order)
        best = found if found.max() < best.max() else best
    return best


PACKED = PIECES + ", sequence_id bigint, offset bigint, certified boolean, gap bigint"


def _pack_groups(pieces: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """Deal pieces to groups by hash and pack each group; ids of sequences start at the group's."""
    seed = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(salt))
    dealt = pieces.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(seed, F.lit(groups)).alias("_group")
    )

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        lengths = rows["length"].to_numpy()
        bound = lower_bound(lengths, capacity)
        if salt == 1:
            bins = best_fit_decreasing(lengths, capacity)
        else:
            bins = best_of_orders(lengths, bound, salt, capacity)
        opened = int(bins.max()) + 1
        out = rows.drop(columns="_group")
        # Above the bits of the place in a group: the salt and the group.
        out["sequence_id"] = ((salt * (1 << 26) + int(key[0])) << 24) + bins
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        out["certified"], out["gap"] = opened <= bound, opened - bound
        return out

    return dealt.groupBy("_group").applyInPandas(pack, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Put staged pieces into sequences; adds sequence_id, offset, certified and gap."""
    full = pieces.where(F.col("length") == capacity)
    alone = full.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        F.lit(True).alias("certified"),
        F.lit(0).cast("bigint").alias("gap"),
    )

    def again(waiting: DataFrame, salt: int) -> DataFrame:
        groups = max(1, round(waiting.count() / PARTITION_PIECES))
        return keep(_pack_groups(waiting, groups, salt, capacity), f"packed{salt}")

    packed, salt = again(pieces.where(F.col("length") < capacity), 1), 1
    result = packed.where("certified")
    while True:
        waiting = packed.where("NOT certified")
        before = _sequences(waiting)
        if not before:
            break
        salt += 1
        packed = again(waiting, salt)
        if _sequences(packed) >= before:
            result = result.unionByName(waiting)
            break
        result = result.unionByName(packed.where("certified"))
    fill = result.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    emptiest = fill.groupBy(F.shiftright("sequence_id", 24)).agg(F.min(F.struct("fill", "sequence_id")).alias("e"))
    emptiest = keep(emptiest.select("e.sequence_id"), "emptiest")
    before = emptiest.count()
    if before > 1:
        packed = again(result.join(emptiest, "sequence_id", "left_semi"), salt + 1)
        if _sequences(packed) < before:
            result = result.join(emptiest, "sequence_id", "left_anti").unionByName(packed)
    return alone.unionByName(result)


def _sequences(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, gap.

    ``certified`` says that the partition of the sequence has no more sequences than its
    lower bound, ``gap`` how many it has beyond it.
    Documents longer than ``capacity`` tokens are cut, others stay whole. Null and empty
    texts are one piece of one token; null ids are carried along, repeated rows are packed
    each. An empty table gives no rows.
    """
    return pack_pieces(keep(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
