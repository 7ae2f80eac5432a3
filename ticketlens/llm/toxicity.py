"""Toxicity by weak supervision.

Voters are lexicons of words and word beginnings, and patterns of writing. Each fires or
not on a text. A generative label model (one hidden class, firing rates per class) is fitted
by expectation maximisation on the votes of all documents, counted in Spark; voters that
agree more than the class explains are grouped, and a group shares one vote. Its posteriors
are the labels on which a linear classifier over words and word beginnings is trained.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import in_pieces, keep, split_words, whole_text

#: Labelled rows that lexicons and classifier are fitted on, at most (the smallest by a hash of the id).
TRAIN_ROWS = 12_000
#: Words and word beginnings the classifier knows, for and against.
FEATURES_FOR, FEATURES_AGAINST = 1_500, 300
#: Lexicon voters, and entries that are dealt to them.
LEXICONS, LEXICON_ENTRIES = 24, 240
BEGINNINGS = (4, 5, 6, 7)
ROUNDS = 5
#: Residual agreement beyond which two voters count as one.
CORRELATED = 0.6


def train_fold() -> Column:
    """Rows whose labels may be learned from; the others are held out."""
    return ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(words: pa.Array) -> list[pa.Array]:
    """Per word its letters in lower case, and its beginnings; null where a word has none."""
    letters = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pM]+", "")
    size = pc.utf8_length(letters)
    nothing, star, none = (pa.scalar(x, letters.type) for x in (None, "*", ""))
    out = [pc.if_else(pc.greater(size, 0), letters, nothing)]
    for n in BEGINNINGS:
        start = pc.binary_join_element_wise(pc.utf8_slice_codeunits(letters, 0, n), star, none)
        out.append(pc.if_else(pc.greater_equal(size, n), start, nothing))
    return out


# -- features and votes of texts -----------------------------------------------------

#: Pattern voters: bytes of a kind, and the share of a text from which they fire.
PATTERNS = (
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.4),
    (b"!", 0.03),
    (b"#$%&*", 0.1),
    (b"0123456789", 0.1),
    (b"|", 0.02),
    (bytes(range(128, 256)), 0.08),
)
#: Voters on the share of a text's words that any lexicon has, in per cent.
OVERALL = (0.5, 1.0, 1.5)
#: A lexicon fires once if it has a word of the text, and again if it has this share of them.
DENSE = 0.5
VOTERS = 2 * LEXICONS + len(OVERALL) + len(PATTERNS)
#: A feature's value is its share of a text's words in per cent, up to this.
MOST_SHARE = 3.0


class Reader:
    """Features and votes of texts, for a fixed vocabulary and fixed lexicons."""

    def __init__(self, vocabulary: dict[str, int], lexicon: dict[str, int]):
        self.names = pa.array(list(vocabulary), pa.large_string())
        self.numbers = np.array([*vocabulary.values(), -1], np.int64)
        self.entries = pa.array(list(lexicon), pa.large_string())
        self.lexicons = np.array([*lexicon.values(), -1], np.int64)
        self.size = len(vocabulary)

    @staticmethod
    def _lookup(features: list[pa.Array], names: pa.Array, numbers: np.ndarray) -> np.ndarray:
        """The number of each feature of each word, -1 for none."""
        places = [pc.fill_null(pc.index_in(f, value_set=names), -1).to_numpy(zero_copy_only=False) for f in features]
        return numbers[np.stack(places, axis=1)]

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and values of all texts, and per text the share of each lexicon's words.

        The last feature, after those of the vocabulary, is the share of all lexicons.
        """
        words, starts = split_words(texts)
        coded = words.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        features = word_features(distinct)
        texts_read, n = len(starts) - 1, np.maximum(np.diff(starts), 1)
        row = np.repeat(np.arange(texts_read), np.diff(starts))
        entry = self._lookup(features, self.entries, self.lexicons)
        # A word counts for one lexicon: that of its first feature that any has.
        lexicon = entry[np.arange(len(entry)), (entry >= 0).argmax(axis=1)][codes]
        firing = lexicon >= 0
        hits = np.bincount(row[firing] * LEXICONS + lexicon[firing], minlength=texts_read * LEXICONS)
        share = 100.0 * hits.reshape(texts_read, LEXICONS) / n[:, None]
        number = self._lookup(features, self.names, self.numbers)
        hit = (number >= 0).any(axis=1)[codes]
        found = number[codes[hit]]
        inside = found >= 0
        at = np.repeat(row[hit], inside.sum(axis=1))
        pairs, times = np.unique(at * (1 << 20) + found[inside], return_counts=True)
        value = np.minimum(100.0 * times / n[pairs >> 20], MOST_SHARE)
        total = np.minimum(share.sum(axis=1), MOST_SHARE)
        some = np.flatnonzero(total)
        rows = np.concatenate([pairs >> 20, some])
        numbers = np.concatenate([pairs & ((1 << 20) - 1), np.full(len(some), self.size)])
        order = np.argsort(rows, kind="stable")
        return rows[order], numbers[order], np.concatenate([value, total[some]])[order], share

    def votes(self, texts: pa.Array, share: np.ndarray) -> np.ndarray:
        """All votes of each text, one bit per voter; ``share`` is that of ``read``."""
        data = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(data).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        raw = np.frombuffer("".join(data.to_pylist()).encode(), np.uint8)
        written = []
        for kind, least in PATTERNS:
            inside = np.zeros(256, np.uint8)
            inside[list(kind)] = 1
            before = np.concatenate([[0], np.cumsum(inside[raw], dtype=np.int64)])
            written.append((before[ends] - before[ends - size] >= least * size) & (size > 0))
        overall = share.sum(axis=1)[:, None] >= np.array(OVERALL)
        fires = np.concatenate([share > 0, share >= DENSE, overall, np.stack(written, axis=1)], axis=1)
        return (fires.astype(np.int64) << np.arange(VOTERS)).sum(axis=1)


def _bits(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


# -- label model ---------------------------------------------------------------------


@dataclass
class LabelModel:
    """Class share, firing rates of each voter per class, and the weight of each voter's vote."""

    prior: float
    rates: np.ndarray  # 2 x VOTERS
    weights: np.ndarray  # VOTERS

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        r = np.clip(self.rates, 1e-4, 1 - 1e-4)
        fire, rest = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
        p = np.clip(self.prior, 1e-4, 1 - 1e-4)
        z = np.log(p / (1 - p)) + bits @ (self.weights * (fire - rest)) + (self.weights * rest).sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expected(masks: DataFrame, model: LabelModel, pairs: bool) -> np.ndarray:
    """Sums over all documents of class posterior times votes, or times pairs of votes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            bits = _bits(batch.column("mask").to_numpy())
            times = batch.column("times").to_numpy().astype(np.float64)
            q = model.posterior(bits)
            both = np.stack([(1 - q) * times, q * times])
            one = np.concatenate([both.sum(axis=1), (both @ bits).ravel()])
            if pairs:
                one = np.concatenate([one, *((bits.T @ (bits * w[:, None])).ravel() for w in both)])
            total = total + one
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    size = 2 + 2 * VOTERS + (2 * VOTERS * VOTERS if pairs else 0)
    out = np.zeros(size)
    # One row per statistic: as many for any input.
    for i, x in masks.mapInArrow(add, "i bigint, x double").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def fit_label_model(masks: DataFrame, start: LabelModel, known: np.ndarray | None = None) -> LabelModel:
    """Expectation maximisation over the counted votes (``mask``, ``times``) of all documents.

    ``known`` holds the same sums (class sizes, then votes per class) of labelled rows. Scaled
    to weigh as much as all documents, they keep the hidden class from drifting to whatever
    else votes have in common, such as the length of a text.
    """
    model = start
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 2
        s = _expected(masks, model, pairs=last)
        if s[:2].sum() == 0:
            return model
        seen = s[: 2 + 2 * VOTERS]
        if known is not None:
            seen = seen + known * (s[:2].sum() / known[:2].sum())
        n, fired = seen[:2], seen[2:].reshape(2, VOTERS)
        rates = (fired + 0.05) / (n[:, None] + 0.1)
        model = LabelModel(float(n[1] / n.sum()), rates, model.weights)
        if last:
            own = np.maximum(s[:2], 1e-9)
            mean = s[2 : 2 + 2 * VOTERS].reshape(2, VOTERS) / own[:, None]
            joint = s[2 + 2 * VOTERS :].reshape(2, VOTERS, VOTERS) / own[:, None, None]
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-6))
            excess = (joint - mean[:, :, None] * mean[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
            tied = (np.abs(excess).max(axis=0) > CORRELATED) | np.eye(VOTERS, dtype=bool)
            model = LabelModel(model.prior, rates, 1 / tied.sum(axis=1))
    return model


# -- training ------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    lexicon: dict[str, int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        reader = Reader(self.vocabulary, self.lexicon)

        def score(texts: pa.Array) -> np.ndarray:
            row, feature, value, _ = reader.read(texts)
            z = self.bias + np.bincount(row, self.weights[feature] * value, minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

        return score


def _feature_counts(sample: DataFrame) -> DataFrame:
    """Texts of either label that have each feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in in_pieces(batches, "text"):
            words, starts = split_words(batch.column("text"))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            columns = [f.to_pylist() for f in word_features(coded.dictionary)]
            names = [[n for n in found if n is not None] for found in zip(*columns)]
            for a, b, toxic in zip(starts[:-1], starts[1:], batch.column("toxic").to_pylist()):
                seen[toxic].update({n for c in np.unique(codes[a:b]) for n in names[c]})
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), *(pa.array([c[k] for k in every], pa.int64()) for c in seen)],
            ["feature", "clean", "toxic"],
        )

    parts = sample.select("text", "toxic").mapInArrow(count, "feature string, clean bigint, toxic bigint")
    return parts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _strongest(counts: DataFrame, clean: int, toxic: int) -> tuple[list[str], list[str]]:
    """Features for and against the label, strongest first, by signed likelihood ratio."""
    a, b = F.col("toxic"), F.col("clean")
    p, q, r = (a + 0.5) / (toxic + 1.0), (b + 0.5) / (clean + 1.0), (a + b + 1.0) / (clean + toxic + 2.0)
    gain = a * F.log(p / r) + b * F.log(q / r) + (toxic - a) * F.log((1 - p) / (1 - r)) + (clean - b) * F.log((1 - q) / (1 - r))
    # Of so many features tried, chance gives some a gain; those only say that a text is long.
    tried = counts.where(a + b >= 3)
    scored = tried.where(gain >= math.log(1 + tried.count())).withColumn("gain", F.when(p > q, gain).otherwise(-gain))
    up = scored.where((F.col("gain") > 0) & (p >= 2 * q)).orderBy(F.desc("gain"), "feature").limit(FEATURES_FOR)
    down = scored.where("gain < 0").orderBy("gain", "feature").limit(FEATURES_AGAINST)
    return [r[0] for r in up.select("feature").collect()], [r[0] for r in down.select("feature").collect()]


def _lexicons(strongest: list[str]) -> dict[str, int]:
    """The lexicon of each entry. Entries that begin alike mostly fire together: they share one."""
    stems: dict[str, int] = {}
    return {name: stems.setdefault(name[: BEGINNINGS[0]], len(stems)) % LEXICONS for name in strongest}


def _logistic(
    row: np.ndarray, col: np.ndarray, value: np.ndarray, target: np.ndarray, size: int
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, ridge penalty, full-batch Adam."""
    n = len(target)
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    share = np.clip(target.mean(), 0.01, 0.99)
    w[size] = np.log(share / (1 - share))
    for t in range(1, 301):
        z = w[size] + np.bincount(row, w[col] * value, minlength=n)
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.append(np.bincount(col, error[row] * value, minlength=size), error.sum()) / n
        g[:size] += 2e-4 * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit voters, label model and classifier; only labels of the train fold are read.

    Labels other than 0 and 1, and null ids, teach nothing. Without labels of both kinds the
    model scores every text 0.
    """
    usable = labels.where(train_fold() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = usable.select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    # At most train_rows rows of two numbers.
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text per label, chosen by its hash: an id with many rows teaches no more than another.
    text = F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")
    one_each = rows.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(text)
    sample = keep(one_each.select("text", "toxic"), "labelled")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return ToxicityModel({}, {}, np.zeros(1), -40.0)
    up, down = _strongest(keep(_feature_counts(sample), "features"), clean, toxic)
    vocabulary = {name: i for i, name in enumerate([*up, *down])}
    lexicon = _lexicons(up[:LEXICON_ENTRIES])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader({}, lexicon)
        for batch in in_pieces(batches, "text"):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([pa.array(reader.votes(texts, reader.read(texts)[3]))], ["mask"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocabulary, lexicon)
        for batch in in_pieces(batches, "text"):
            row, feature, value, share = reader.read(batch.column("text"))
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array(reader.votes(batch.column("text"), share)),
                    pa.ListArray.from_arrays(cuts, pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(cuts, pa.array(value)),
                ],
                ["toxic", "mask", "features", "values"],
            )

    masks = docs.select(whole_text().alias("text")).mapInArrow(votes, "mask bigint")
    masks = keep(masks.groupBy("mask").agg(F.count(F.lit(1)).alias("times")), "votes")
    # Bounded by train_rows; a text has as many features as the vocabulary at most.
    seen = sample.mapInArrow(read, "toxic int, mask bigint, features array<int>, values array<double>").toArrow()
    bits, label = _bits(seen.column("mask").to_numpy()), seen.column("toxic").to_numpy()
    rates = np.stack([(bits[label == y].sum(axis=0) + 0.5) / ((label == y).sum() + 1.0) for y in (0, 1)])
    known = np.concatenate([[clean, toxic], *(bits[label == y].sum(axis=0) for y in (0, 1))])
    model = fit_label_model(masks, LabelModel(toxic / (clean + toxic), rates, np.ones(VOTERS)), known)
    target = model.posterior(bits)
    features, values = (seen.column(c).combine_chunks() for c in ("features", "values"))
    size = np.diff(features.offsets.to_numpy())
    weights, bias = _logistic(
        np.repeat(np.arange(len(size)), size),
        features.flatten().to_numpy().astype(np.int64),
        values.flatten().to_numpy(),
        target,
        len(vocabulary) + 1,
    )
    return ToxicityModel(vocabulary, lexicon, weights, bias)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text gets the score of a text without any known word. Null ids are not
    held out; repeated rows get equal scores; an empty table gives no rows.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in in_pieces(batches, "text"):
            s = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for batch in texts:
            yield pa.array(scorer(batch))

    return docs.where(score(whole_text()) < threshold)
