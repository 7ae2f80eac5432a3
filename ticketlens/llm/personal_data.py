"""Personal data by patterns and by bootstrapped context, in built-in functions only.

Base entities (email, ip, card, phone) are found by patterns. They are the seeds: the words
before them are lexical patterns, and so are the words before other strings of digits and
letters. Patterns and values form a graph, on which confidence goes back and forth: a
pattern is as good as the values that it introduces, a value as good as its patterns.
Strings that good patterns introduce are identifiers, and evidence for further patterns in
the next round, until no pattern is new. A pattern also has to be typical: words that mostly
stand before something else are none, which their counts over the whole corpus tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import keep, whole_text

#: Base patterns, in the order of kinds. They find the same as the plain forms but never try
#: a run of characters twice, and of card numbers only chains of 16 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other strings that may be identifiers: letters, digits and hyphens, four digits at least.
OTHER = r"(?<![\p{L}\p{N}_.@-])(?:[A-Za-z][A-Za-z-]*+)?+[0-9](?=(?:[A-Za-z-]*+[0-9]){3})[A-Za-z0-9-]*+(?![\p{L}\p{N}_@])"
KINDS = [*PATTERNS, "identifier"]

#: A pattern needs so many different scored values, this confidence, and to stand before a
#: match in this share of its places in the corpus, to name identifiers.
LEAST_VALUES, CONFIDENT, TYPICAL = 3, 0.8, 0.2


def _matches(text: Column, found: Column, kind: str, pattern: str) -> Column:
    """The matches of a kind in order: what lies before each (length and last words), and the match.

    The words of a context are the last two in the last four pieces between spaces.
    """
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda match, left: F.struct(match.alias("match"), left.alias("left")))
    return F.transform(
        # There is one piece more than matches: what follows the last one.
        F.filter(pairs, lambda pair: pair["match"].isNotNull()),
        lambda pair, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("place"),
            F.length(pair["left"]).alias("gap"),
            F.slice(F.concat(F.array(F.lit(""), F.lit("")), _words(F.substring_index(pair["left"], " ", -4))), -2, 2).alias("two"),
            pair["match"].alias("match"),
        ),
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether the digits of a card number pass the Luhn check."""
    digits = F.reverse(_digits(match))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))),
        F.lit(0),
        lambda s, i: s
        + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (2 * F.substring(digits, i, F.lit(1)).cast("int")) % 10
            + F.when(F.substring(digits, i, F.lit(1)).cast("int") >= 5, 1).otherwise(0)
        ),
    )
    return total % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """The rules beyond the patterns."""
    count = F.length(_digits(match))
    small = F.forall(
        F.split(match, r"\."),
        lambda part: F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3,
    ) & F.forall(
        F.split(match, r"\."), lambda part: F.right(part, F.lit(3)).try_cast("int") <= 255
    )
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, small)
        .when(kind == 2, count.between(16, 19) & _luhn(match))
        .when(kind == 3, count.between(8, 15))
        .otherwise(count >= 4)
    )


#: Every match of a kind holds this character.
_MARKS = {"email": "@", "ip": ".", "phone": "+"}


def find_matches(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, and all matches of all kinds.

    Texts are read once, and cut into the pieces between matches only where there are some.
    """
    text = F.col("text")
    patterns = {**PATTERNS, "identifier": OTHER}
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns.values()]
    found = [
        (F.when(F.contains(text, F.lit(_MARKS[k])), f) if k in _MARKS else f).alias(f"found_{k}")
        for k, f in zip(patterns, found)
    ]
    rows = docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", *found)
    arrays = [
        F.when(F.size(f"found_{k}") > 0, _matches(text, F.col(f"found_{k}"), k, p)) for k, p in patterns.items()
    ]
    matches = F.flatten(F.array_compact(F.array(*arrays)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", matches.alias("matches"))


def placed_spans(found: DataFrame) -> DataFrame:
    """One row per match that holds: row, kind, start, end, value and the words before it.

    Code points, end exclusive. Matches that overlap a base span are no other strings.
    """
    exploded = found.select("row", F.inline("matches"))
    order = Window.partitionBy("row", "kind").orderBy("place")
    upto = F.sum(F.col("gap") + F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = exploded.withColumn("end", upto.cast("bigint")).withColumn("start", F.col("end") - F.length("match"))
    held = spans.where(_holds(F.col("kind"), F.col("match")))
    # Ends of base spans reach over what starts before them: a running maximum finds overlaps.
    along = Window.partitionBy("row").orderBy("start", "kind")
    base_end = F.when(F.col("kind") < 4, F.col("end"))
    next_base = F.min(F.when(F.col("kind") < 4, F.col("start"))).over(along.rowsBetween(1, Window.unboundedFollowing))
    reach = F.max(base_end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (
        F.coalesce(next_base, F.col("end")) >= F.col("end")
    )
    last, pair = F.get("two", F.lit(1)), F.concat_ws(" ", "two")
    patterns = F.array(F.when(last != "", last), F.when(F.get("two", F.lit(0)) != "", pair))
    return (
        held.withColumn("free", free)
        .where((F.col("kind") < 4) | F.col("free"))
        .select("row", "kind", "start", "end", F.lower("match").alias("value"), F.array_compact(patterns).alias("patterns"))
    )


def pattern_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, occurrences: how often the words of the given patterns stand in all texts."""
    words = F.split(F.lower(whole_text()), r"[^\p{L}]+")
    after = F.slice(words, F.lit(2), F.size(words))
    grams = F.concat(words, F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b)))
    return (
        docs.select(F.explode(grams).alias("pattern"))
        .join(patterns, "pattern", "left_semi")
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def pattern_graph(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """pattern, value, seed: which patterns introduce which values; typical patterns only."""
    edges = (
        spans.select("value", (F.col("kind") < 4).alias("seed"), F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("places"))
    )
    edges = keep(edges, "edges")
    # A pattern can't have more scored values than values.
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("places").alias("places"))
    wide = keep(wide.where(F.col("values") >= LEAST_VALUES).select("pattern", "places"), "wide")
    typical = wide.join(pattern_counts(docs, wide.select("pattern")), "pattern", "left").where(
        F.col("places") >= TYPICAL * F.coalesce("occurrences", "places")
    )
    return keep(edges.join(typical, "pattern", "left_semi").select("pattern", "value", "seed"), "graph")


def confident_patterns(graph: DataFrame) -> DataFrame:
    """pattern, confidence: patterns that introduce identifiers, by scores on the graph.

    A pattern's confidence is the score of its values by their number (one more in the count:
    few values never make a pattern certain). The patterns that a round accepts score the
    values not scored before (the chance that one of them is right), and the next round
    counts these. It ends when no pattern is new, so after as many rounds as the longest chain.
    """
    scores = graph.where("seed").select("value", F.lit(1.0).alias("score")).distinct()
    accepted = None
    turn = 0
    while True:
        scores = keep(scores, f"scores{turn}")
        judged = graph.join(scores, "value", "left").groupBy("pattern").agg(
            (F.coalesce(F.sum("score"), F.lit(0.0)) / (F.count(F.lit(1)) + 1)).alias("confidence"),
            F.count("score").alias("scored"),
        )
        good = judged.where((F.col("scored") >= LEAST_VALUES) & (F.col("confidence") >= CONFIDENT)).drop("scored")
        fresh = keep(good if accepted is None else good.join(accepted, "pattern", "left_anti"), f"fresh{turn}")
        accepted = fresh if accepted is None else accepted.unionByName(fresh)
        if fresh.isEmpty():
            return accepted
        missed = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        reached = graph.join(fresh, "pattern").join(scores, "value", "left_anti")
        scores = scores.unionByName(reached.groupBy("value").agg((1 - F.exp(missed)).alias("score")))
        turn += 1


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the spans of each kind, and found identifiers.

    ``spans`` is an array of (kind number, start, end, kind), by kind as listed and then
    start. Null and empty texts have none. Rows with null or repeated ids are told apart by
    their place in the input; an empty table gives no rows.
    """
    found = keep(find_matches(docs), "matches")
    spans = keep(placed_spans(found), "spans")
    patterns = confident_patterns(pattern_graph(docs, spans))
    introduced = (
        spans.where("kind = 4")
        .select("row", "kind", "start", "end", F.explode("patterns").alias("pattern"))
        .join(patterns, "pattern", "left_semi")
        .select("row", "kind", "start", "end")
        .distinct()
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = (
        spans.where("kind < 4")
        .select("row", "kind", "start", "end")
        .unionByName(introduced)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    )
    named = F.transform(
        F.coalesce("spans", F.expr("array()").cast("array<struct<kind:int,start:bigint,end:bigint>>")),
        lambda s: F.struct(s["kind"].alias("number"), s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind")),
    )
    return found.select("row", "doc_id").join(listed, "row", "left").select("doc_id", named.alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["number"] < 4)

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["number"] == number)).cast("bigint").alias(f"n_{KINDS[number]}")

    return found.select(
        "doc_id",
        *[count(n) for n in range(4)],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
