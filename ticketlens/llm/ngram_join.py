"""Jaccard self-join of word-shingle sets, by rare-first prefix filtering.

Equal sets become one class, which has a number of its own: rows that share an id may have
different texts, so a row goes by its id and the hash of its text. The shingles of class representatives are counted over the
whole corpus, and each set is ordered by rising document frequency. Sets that are similar
enough share a shingle among the first few (the prefix); shingles of a single set can't be
shared and are left out, so most documents have no prefix at all. Pairs meet on prefix
shingles, pass length, positional and suffix filters, and are verified once: what a round has
verified is left out of all later ones.

Clusters would give all their pairs. Since links only matter up to connection, each round
first pairs the members of a prefix shingle with one leader and joins what is linked;
after that only pairs across components are left, and all of those are verified. There a
pair meets at its first common shingle and few others, not at each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import blocks as B
from ticketlens.llm.common import give_back, in_pieces, keep, lower_ascii, shingle_hashes, split_words, whole_text, word_hashes
from ticketlens.llm.components import components

#: 64-bit words of the parity sketch that the suffix filter compares.
SKETCH_WORDS = 4
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
#: Rounds with leaders, and leaders per token from the second round on.
LEADER_ROUNDS, LEADERS = 3, 3
#: Prefix shingles before its own that an entry carries, to tell that a pair has met. The last ones:
#: the first, rarest ones of a set are in few others, even where later ones are mostly shared.
LAST_TOKENS = 4


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, and where each text's begin."""
    words, starts = split_words(lower_ascii(texts))
    hashes, begins = shingle_hashes(word_hashes(words), starts, size)
    # Many short sorts are much faster than one over pairs of text and hash.
    for a, b in zip(begins[:-1], begins[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[:-1][begins[:-1] < len(hashes)]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[begins]


def set_facts(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles and a 128-bit digest of the shingle set, per row."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text"):
            hashes, begins = shingle_sets(batch.column("text"), size)
            digests = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(begins[:-1], begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(begins)), pa.array(digests, pa.binary())],
                ["doc_id", "mark", "n_shingles", "digest"],
            )

    rows = docs.select("doc_id", text_mark().alias("mark"), whole_text().alias("text"))
    return rows.mapInArrow(facts, "doc_id bigint, mark bigint, n_shingles bigint, digest binary")


def text_mark() -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(whole_text())


def _sets_of(docs: pa.Table, chosen: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, sets and set begins of the chosen documents of a block, each class once."""
    keys = ["doc_id", "mark"]
    wanted = dict(zip(zip(*(chosen.column(k).to_pylist() for k in keys)), chosen.column("class").to_pylist()))
    at, found = [], []
    for row, key in enumerate(zip(*(docs.column(k).to_pylist() for k in keys))):
        number = wanted.pop(key, None)
        if number is not None:
            at.append(row)
            found.append(number)
    texts = docs.column("text").combine_chunks().take(pa.array(at, pa.int64()))
    hashes, begins = shingle_sets(texts, size)
    return np.array(found, np.int64), hashes, begins


def _packets(size: int, buckets: int):
    def send(key: tuple, docs: pa.Table, chosen: pa.Table) -> pa.Table:
        _, hashes, _ = _sets_of(docs, chosen, size)
        hashes.sort()
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        keys, counts = hashes[begin], np.diff(np.append(begin, len(hashes)))
        cuts = B.bucket_cuts(keys, buckets)
        rows = [
            (b, key[0].as_py(), B.squeeze_sorted(keys[a:e]), B.squeeze(counts[a:e].astype(np.uint32)))
            for b, (a, e) in enumerate(zip(cuts[:-1], cuts[1:]))
            if e > a
        ]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        del hashes, begin, keys, counts
        give_back()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "block", "keys", "counts"])

    return send


def _frequencies(key: tuple, batches: pa.Table) -> pa.Table:
    """Answer each packet with the corpus counts of its keys."""
    packets = batches
    keys = [B.unsqueeze_sorted(x.as_py()) for x in packets.column("keys")]
    counts = np.concatenate([B.unsqueeze(x.as_py(), np.uint32) for x in packets.column("counts")])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, counts).astype(np.uint64)[inverse]
    total = np.minimum(total, np.uint64((1 << 32) - 1)).astype(np.uint32)
    ends = np.cumsum([len(k) for k in keys])
    out = [B.squeeze(total[e - len(k) : e]) for k, e in zip(keys, ends)]
    return pa.table(
        [packets.column("block"), packets.column("bucket"), pa.array(out, pa.binary())],
        names=["block", "bucket", "totals"],
    )


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """Bit k says whether an odd number of the set's hashes end in k.

    Sketches of two sets differ in no more bits than the sets in elements.
    """
    odd = np.bincount((hashes & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _prefixes(size: int, percent: int):
    """Sets with a shared shingle in their prefix, as (tokens, places) of it, with sketch and set."""

    def choose(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        chosen = told.filter(pc.is_valid(told.column("class")))
        answers = told.filter(pc.is_valid(told.column("totals"))).sort_by("bucket")
        ids, hashes, begins = _sets_of(docs, chosen, size)
        totals = np.concatenate(
            [np.zeros(0, np.uint32), *(B.unsqueeze(x.as_py(), np.uint32) for x in answers.column("totals"))]
        )
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        count = np.empty(len(order), np.uint32)
        count[order] = totals[np.cumsum(new) - 1]
        n = np.diff(begins)
        prefix = n - (-(-percent * n // 100)) + 1
        # Shingles of one set come first: where they fill the prefix, nothing can link.
        single = np.diff(np.concatenate([[0], np.cumsum(count == 1)])[begins])
        rows = []
        for d in np.flatnonzero((single < prefix) & (n > 0)):
            own, rare = hashes[begins[d] : begins[d + 1]], count[begins[d] : begins[d + 1]]
            first = np.lexsort((own, rare))[: prefix[d]]
            places = np.flatnonzero(rare[first] > 1)
            rows.append((ids[d], n[d], own[first][places].view(np.int64), places.astype(np.int32), parity_sketch(own), own.view(np.int64)))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        del order, ordered, count, totals
        give_back()
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "n", "tokens", "places", "sketch", "shingles"]
        )

    return choose


def prefix_candidates(docs: DataFrame, chosen: DataFrame, size: int, percent: int, block_bytes: int) -> DataFrame:
    """Chosen documents (doc_id, mark, class) whose prefix holds a shingle that another one has."""
    count = B.block_count(docs, block_bytes)
    block = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(count))
    marked = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_mark().alias("mark"), whole_text().alias("text"))
    placed = marked.select("*", block.alias("block"))
    chosen = chosen.select("doc_id", "mark", "class", block.alias("block"))
    packets = (
        placed.groupBy("block")
        .cogroup(chosen.groupBy("block"))
        .applyInArrow(_packets(size, B.bucket_count(count)), "bucket bigint, block bigint, keys binary, counts binary")
    )
    answers = packets.groupBy("bucket").applyInArrow(_frequencies, "block bigint, bucket bigint, totals binary")
    told = chosen.unionByName(answers, allowMissingColumns=True)
    return (
        placed.groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInArrow(
            _prefixes(size, percent),
            "doc bigint, n bigint, tokens array<bigint>, places array<int>, sketch array<bigint>, shingles array<bigint>",
        )
    )


# -- pairs ---------------------------------------------------------------------------


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Shared shingles that two sets of these sizes need."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-6)


def _may_link(percent: int) -> Column:
    """Length, positional and suffix filter of two entries of one token, a and b."""
    n, m, i, j = F.col("a.n"), F.col("b.n"), F.col("a.place"), F.col("b.place")
    length = (100 * F.least(n, m)) >= (percent * F.greatest(n, m))
    least = _least_overlap(n, m, percent)
    most = 1 + F.least(i, j) + F.least(n - 1 - i, m - 1 - j)
    # What the rest of the sets differ in, at least, by their parity sketches.
    apart = sum(
        (F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(SKETCH_WORDS)), start=F.lit(0)
    )
    return length & (most >= least) & (apart <= n + m - 2 * least)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; each is checked once."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t"))
    links = 100 * both >= percent * (F.size("s") + F.size("t") - both)
    return pairs.join(left, "a").join(right, "b").where(links).select("a", "b")


def _star_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Members of each token with the token's leaders of this round.

    The first round has one, the smallest id, which the tokens of a cluster mostly share;
    later ones have ``LEADERS`` that differ from token to token.
    """
    rest = ["n", "place", "root", *SKETCH]
    if turn == 0:
        ranked = [F.min(F.struct("doc", *rest))]
    else:
        rank = [F.xxhash64("doc", "token", F.lit(turn * LEADERS + k)).alias("rank") for k in range(LEADERS)]
        ranked = [F.min(F.struct(r, "doc", *rest)) for r in rank]
    leaders = entries.groupBy("token").agg(F.array(*ranked).alias("leaders"))
    leaders = leaders.select("token", F.inline(F.array_distinct("leaders")))
    met = entries.alias("a").join(
        leaders.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & _may_link(percent)
    )
    return met.select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b")).distinct()


def _open_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a token and lie in different components.

    Tokens have one order in all sets. A pair that shares one of the tokens just before has met
    there or earlier, so it is passed over; the few others may meet more than once. At its
    first common token it is never passed over.
    """
    met = entries.alias("a").join(
        entries.alias("b"),
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.doc") < F.col("b.doc"))
        & (F.col("a.root") != F.col("b.root"))
        & ~F.arrays_overlap("a.earlier", "b.earlier")
        & _may_link(percent),
    )
    return met.select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()


def linked_components(sets: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``root`` for every document that links with another.

    Leader rounds only save work: whatever they leave apart is paired in full at the end.
    """
    sketch = [F.get("sketch", F.lit(k)).alias(name) for k, name in enumerate(SKETCH)]
    zipped = F.posexplode(F.arrays_zip("tokens", "places")).alias("at", "e")
    exploded = sets.select("doc", "n", *sketch, "tokens", zipped)
    entries = exploded.select(
        "doc",
        "n",
        *SKETCH,
        F.col("e.tokens").alias("token"),
        F.col("e.places").alias("place"),
        F.slice("tokens", F.greatest(F.col("at") - (LAST_TOKENS - 1), F.lit(1)), F.least("at", F.lit(LAST_TOKENS))).alias("earlier"),
    )
    links, roots, tested = None, None, None
    for turn in range(LEADER_ROUNDS + 1):
        rooted = entries.withColumn("root", F.col("doc"))
        if roots is not None:
            known = roots.select(F.col("node").alias("doc"), "root")
            rooted = entries.join(known, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        pairs = _open_pairs(rooted, percent) if turn == LEADER_ROUNDS else _star_pairs(rooted, turn, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = keep(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = keep(_verified(pairs, sets, percent), "links")
        if found.isEmpty() and roots is not None:
            continue
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    return roots if roots is not None else sets.select(F.col("doc").alias("node"), F.col("doc").alias("root")).limit(0)


def _joined(docs: DataFrame, size: int, percent: int, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, and whether the row's set is not its component's first."""
    facts = keep(set_facts(docs, size), "facts")
    classes = (
        facts.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "mark")).alias("rep"))
        .select("digest", "rep.doc_id", "rep.mark", F.monotonically_increasing_id().alias("class"))
    )
    # Stored before anything reads the numbers.
    classes = keep(classes, "classes")
    sets = keep(prefix_candidates(docs, classes, size, percent, block_bytes), "sets")
    roots = linked_components(sets, percent).select(F.col("node").alias("class"), "root")
    rooted = keep(roots.join(classes, "class").select("class", "root", "doc_id", "digest"), "rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    linked = rooted.join(first, "root").select("class", "first")
    # Only classes of several rows, or with links, differ from their document.
    named = classes.join(linked, "class", "left").select(
        "digest",
        F.coalesce("first.doc_id", "doc_id").alias("least"),
        F.coalesce(F.col("first.digest") != F.col("digest"), F.lit(False)).alias("other"),
    )
    return facts.join(named, "digest", "left").select(
        "doc_id",
        "mark",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("other", F.lit(False)).alias("other"),
    )


def ngram_jaccard_join(
    docs: DataFrame, size: int = 4, percent: int = 85, block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without white space, A-Z in lower case; shingles are ``size`` words, or
    the whole sequence of a shorter text. Two documents link when their sets share at least
    ``percent`` per cent of their union; ``component_id`` is the smallest id that links
    reach. Null and empty texts have no shingles and link with nothing. A row with null id
    takes the component of the rows whose set is equal to its own, or null, and links
    nothing by itself; repeated rows get one result row each, and rows with one id and
    different texts each the component of their own text. An empty table gives no rows.
    """
    return _joined(docs, size, percent, block_bytes).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component, with all columns.

    Rows with null id stay, and so do repeats of a row that stays. Of rows with one id only
    those go whose own text is a copy; of near copies with the smallest id one set stays.
    """
    gone = _joined(docs, size, percent).where("doc_id IS NOT NULL AND (component_id <> doc_id OR other)")
    gone = keep(gone.select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark")).distinct(), "gone")
    packed = docs.select("doc_id", text_mark().alias("mark"), F.struct("*").alias("_row"))
    same = (F.col("doc_id") == F.col("_gone")) & (F.col("mark") == F.col("_mark"))
    return packed.join(gone, same, "left_anti").select("_row.*")
