"""How filters that run one after the other interact, in every order, and each one's exact share.

Texts are read once: a row's failed filters become the bits of a mask. Counts per part and
mask are all that is needed. From them the removals of every coalition of filters (rows that
fail any of its members) are tabulated. The Shapley values solve the kernel-weighted least
squares problem over all coalitions, constrained to share the whole removal, in rationals;
differences of coalitions give what each step of each order removes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import keep, whole_text

#: Filters on a row's own text, by letter: conditions under which it fails. ``words`` is an array.
TEXT_FILTERS: dict[str, Column | str] = {
    "A": "size(words) < 200",
    "B": "100 * size(array_distinct(words)) < 50 * size(words)",
    "C": "100 * regexp_count(text, '[A-Z]') > 2 * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
#: The filter that a row fails whose text a smaller id has.
REPEAT_FILTER = "E"

_WORD = r"[^\x20\x09-\x0D]+"
#: What is counted: all rows, those of good quality, toxic ones.
COUNTS = ["n", "good", "toxic"]
#: A text in one of so many rows of the table is a hot one; there are no more of them than this.
HOT_SHARE = 1_000

AUDIT_SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_marks(docs: DataFrame, filters: dict[str, Column | str] = TEXT_FILTERS) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the text filters that a row fails."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole_text().alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("words"))
    fails = [F.expr(f) if isinstance(f, str) else f for f in filters.values()]
    mask = sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(fails)), start=F.lit(0))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    return rows.select("doc_id", "part", digest.alias("digest"), mask.alias("mask"))


def with_repeats(marks: DataFrame, bit: int) -> DataFrame:
    """Marks with ``bit`` set where a smaller id has the same text.

    Texts of a thousandth of all rows or more, a thousand at most, are looked up in a
    broadcast table; no other text is hot in the join.
    """
    total = marks.count()
    firsts = marks.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    firsts = keep(firsts.where("rows > 1 AND least IS NOT NULL"), "firsts")
    is_hot = F.col("rows") * HOT_SHARE >= total
    hot = F.broadcast(firsts.where(is_hot).select("digest", "least"))
    rest = firsts.where(~is_hot).select("digest", "least")
    known = marks.join(hot, "digest").unionByName(
        marks.join(hot, "digest", "left_anti").join(rest, "digest", "left")
    )
    again = F.when(F.col("doc_id") > F.col("least"), 1 << bit).otherwise(0)
    return known.select("doc_id", "part", (F.col("mask") + again).alias("mask"))


def failure_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] = TEXT_FILTERS) -> DataFrame:
    """part, mask, and how many rows, rows of good quality and toxic rows fail exactly these filters."""
    marks = with_repeats(keep(text_marks(docs, filters), "marks"), len(filters))
    # Rows of one id, or of none, are reduced before the join with the labels.
    counted = marks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    rows = counted.join(marked, "doc_id", "left")
    some = [F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *some)


# -- one part ------------------------------------------------------------------------


def coalition_removals(counts: list[int]) -> list[int]:
    """For every set of filters, as a mask, how many rows fail any of them."""
    return [sum(n for mask, n in enumerate(counts) if mask & coalition) for coalition in range(len(counts))]


def shapley_values(removals: list[int]) -> list[Fraction]:
    """Least squares over coalitions with Shapley's kernel, constrained to sum to the whole removal."""
    n = len(removals).bit_length() - 1
    if n == 1:
        return [Fraction(removals[1])]
    weights = [Fraction(0)] * len(removals)
    for coalition in range(1, len(removals) - 1):
        size = coalition.bit_count()
        weights[coalition] = Fraction(n - 1, comb(n, size) * size * (n - size))
    # Normal equations, and a last row and column for the constraint and its multiplier.
    rows = [
        [sum(w for s, w in enumerate(weights) if s >> i & 1 and s >> j & 1) for j in range(n)]
        + [Fraction(1), sum(w * removals[s] for s, w in enumerate(weights) if s >> i & 1)]
        for i in range(n)
    ]
    rows.append([Fraction(1)] * n + [Fraction(0), Fraction(removals[-1])])
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[-1] for row in rows[:n]]


def audit_rows(part: str, cells: dict[int, tuple[int, int, int]], letters: str) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, step by step."""
    everything = (1 << len(letters)) - 1
    n, good, toxic = ([cells.get(mask, (0, 0, 0))[k] for mask in range(everything + 1)] for k in range(3))
    gone, good_gone, toxic_gone = map(coalition_removals, (n, good, toxic))
    shares = [int(share * factorial(len(letters))) for share in shapley_values(gone)]
    for order in permutations(range(len(letters))):
        before = 0
        for step, bit in enumerate(order, 1):
            after = before | 1 << bit
            removed = gone[after] - gone[before]
            yield (
                part,
                "".join(letters[b] for b in order),
                step,
                sum(n) - gone[after],
                removed,
                gone[1 << bit] - removed,
                gone[everything] - gone[everything ^ 1 << bit],
                good_gone[after] - good_gone[before],
                toxic_gone[after] - toxic_gone[before],
                shares[bit],
            )
            before = after


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] = TEXT_FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: what the step's filter removes there.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns
    are not looked at. ``filters`` are conditions on ``text`` and ``words`` by letter, and
    ``REPEAT_FILTER`` is added to them. A null text is empty, a null source the part ''. A
    text that is empty has no words: it passes filters on shares. A row fails the repeat filter
    if a smaller id has its text; rows with equal ids, and null ids on either side, do not
    count as smaller. Repeated rows count as often as they occur. Of several labels of one id
    any that says 1 counts; labels of null or unknown ids count nowhere. Filters that nothing
    fails have rows of zeros; an empty table has no parts and gives no rows.
    """
    letters = "".join(filters) + REPEAT_FILTER

    def audit(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        # One row per mask: 2 ** len(letters) at most.
        found = {row[0]: row[1:] for row in cells[["mask", *COUNTS]].itertuples(index=False, name=None)}
        return pd.DataFrame(audit_rows(key[0], found, letters))

    cells = failure_cells(docs, labels, filters)
    return cells.groupBy("part").applyInPandas(audit, AUDIT_SCHEMA)
