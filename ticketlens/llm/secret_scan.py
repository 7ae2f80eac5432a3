"""Secrets by regular expressions, through an inverted index of trigrams, in built-in functions only.

From each rule's expression follows a Boolean query: which trigrams every text with a match
must hold. The index has one row per segment of documents and trigram, with the documents
that hold it. Queries intersect and unite these postings, and only the documents that are left
are read again and matched. A rule whose expression has no mandatory trigram is matched
against all texts, while these are read for the index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as RE  # Python's own parser of expressions
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketlens.llm.common import keep, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` has ``least`` characters or more.

    Matches are leftmost and do not overlap; one that is too short is dropped, not retried.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Kinds whose spans every scan must find, in the order in which they are listed.
BASE_RULES = [
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # Runs are maximal, so this finds the runs of 32 characters or more and no others.
    Rule("hex", r"[0-9a-f]{32,}"),
]
#: Public formats of keys and tokens beyond those.
MORE_RULES = [
    # Three words at most: the regex engine goes one call deeper for each repetition of a group.
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,16} ){0,3}PRIVATE KEY-----"),
    Rule("temporary_access", r"ASIA[A-Z0-9]+", least=16),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/-]+)", group=1, least=20),
    Rule("login_url", r"://[A-Za-z0-9._~-]+:([^\x00-\x20/@:]+)@", group=1, least=4),
]
RULES = BASE_RULES + MORE_RULES

#: Documents of a segment, about: bounds a posting list and what one query row holds.
SEGMENT_DOCS = 8_192
#: Texts that one part of an expression may stand for; beyond, it says only what all of them hold.
MOST_TEXTS = 64

# -- from expressions to queries -----------------------------------------------------

#: A query is an "or" of "and"s of trigrams; the empty "and" is true, so it says nothing.
Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def _simple(clauses) -> Query:
    """Without clauses that another one makes superfluous."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(other < c for other in clauses))


def _and(a: Query, b: Query) -> Query:
    both = _simple(x | y for x in a for y in b)
    # A product that grows too large is a weaker query: the side with fewer clauses.
    return both if len(both) <= MOST_TEXTS else min(a, b, key=len)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _holding(texts: set[str]) -> Query:
    return _simple(_trigrams(t) for t in texts)


def _class_texts(items) -> set[str] | None:
    """The characters of a class, in lower case; none if there are too many or it is negated."""
    found = set()
    for op, value in items:
        if op is RE.LITERAL:
            found.add(chr(value).lower())
        elif op is RE.RANGE and value[1] - value[0] < 2 * MOST_TEXTS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= MOST_TEXTS // 4 else None


def _follow(nodes, texts: set[str] | None) -> tuple[set[str] | None, Query]:
    """The texts a sequence of nodes stands for (none if unknown), and what it says beyond them.

    ``texts`` are those of what comes before; where the next node is not exact they are
    turned into a query and a new run begins.
    """
    query, exact = ANYTHING, texts is not None
    current = texts if exact else {""}
    for op, value in nodes:
        said, own = _node(op, value)
        if own is not None and len(current) * len(own) <= MOST_TEXTS:
            current = {a + b for a in current for b in own}
            continue
        query = _and(query, _holding(current))
        exact = False
        query = _and(query, said if own is None else ANYTHING)
        current = own if own is not None else {""}
    if exact:
        return current, query
    return None, _and(query, _holding(current))


def _node(op, value) -> tuple[Query, set[str] | None]:
    """What a node says if its texts are unknown, and else its texts."""
    if op is RE.LITERAL:
        return ANYTHING, {chr(value).lower()}
    if op is RE.IN:
        return ANYTHING, _class_texts(value)
    if op is RE.SUBPATTERN:
        texts, query = _follow(value[3], {""})
        return query, texts
    if op is RE.BRANCH:
        parts = [_follow(part, {""}) for part in value[1]]
        if all(texts is not None for texts, _ in parts):
            joined = set().union(*(texts for texts, _ in parts))
            if len(joined) <= MOST_TEXTS:
                return ANYTHING, joined
        queries = [query if texts is None else _holding(texts) for texts, query in parts]
        return _simple(c for q in queries for c in q), None
    if op in (RE.MAX_REPEAT, RE.MIN_REPEAT, RE.POSSESSIVE_REPEAT):
        least, most, inner = value
        texts, query = _follow(inner, {""})
        if texts is not None and (least, most) == (1, 1):
            return ANYTHING, texts
        if texts is not None and (least, most) == (0, 1):
            return ANYTHING, texts | {""}
        if least == 0:
            return ANYTHING, None
        return (query if texts is None else _holding(texts)), None
    if op is RE.AT:
        return ANYTHING, {""}
    # Whatever else an expression may hold says nothing.
    return ANYTHING, None


def trigram_query(pattern: str) -> Query:
    """Trigrams, in lower case, that a text with a match of the expression must hold."""
    if not pattern.isascii():
        # Lower case of other letters depends on who makes it.
        return ANYTHING
    texts, query = _follow(_parser.parse(pattern), {""})
    return query if texts is None else _holding(texts)


def is_indexed(rule: Rule) -> bool:
    return frozenset() not in trigram_query(rule.pattern)


def query_trigrams(rules: list[Rule]) -> list[str]:
    """All trigrams that the rules' queries name: what the index has to hold."""
    return sorted({t for r in rules if is_indexed(r) for clause in trigram_query(r.pattern) for t in clause})


# -- the index -----------------------------------------------------------------------


def text_key() -> Column:
    """Tells rows apart that differ in id or text."""
    known = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")
    return F.unhex(F.sha2(known.cast("binary"), 256))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", whole_text().alias("text")).select("doc_id", "text", text_key().alias("key"))


def _held(text: Column, trigrams: list[str]) -> Column:
    """The places of the trigrams in the list that a text holds, whatever their case."""
    if not trigrams:
        return F.expr("CAST(array() AS array<int>)")
    known = F.array(*[F.lit(t) for t in trigrams])
    places = F.sequence(F.lit(0), F.lit(len(trigrams) - 1))
    # An array of one text: so it is lowered once, and not for every trigram.
    once = F.transform(F.array(F.lower(text)), lambda low: F.filter(places, lambda i: F.contains(low, F.get(known, i))))
    return F.get(once, F.lit(0))


def _pieces(text: Column, rule: Rule, number: int) -> Column:
    """Matches of a rule in order: its number, and how long gap before, match and group are."""
    pattern = F.lit(rule.pattern)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else found
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("size"), sized.alias("sized"))
    return F.transform(
        zipped,
        lambda p: F.struct(
            F.lit(number).alias("number"),
            p["gap"].alias("gap"),
            p["size"].alias("size"),
            (p["sized"] >= rule.least).alias("held"),
        ),
    )


def _no_pieces() -> Column:
    return F.expr("CAST(array() AS array<struct<number:int,gap:int,size:int,held:boolean>>)")


def scan_texts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document, from the only pass over all texts.

    doc_id, key, the held trigrams of the rules' queries, and the matches of the rules that
    have no mandatory trigram.
    """
    text = F.col("text")
    full = [
        F.when(text.rlike(rule.pattern), _pieces(text, rule, n)).otherwise(_no_pieces())
        for n, rule in enumerate(rules)
        if not is_indexed(rule)
    ]
    return _rows(docs).select(
        "doc_id",
        "key",
        _held(text, query_trigrams(rules)).alias("grams"),
        (F.concat(*full) if full else _no_pieces()).alias("pieces"),
    )


def posting_lists(scanned: DataFrame, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The inverted index: segment, trigram (its place in the list), and the documents that hold it.

    A document goes by a 64-bit hash of its key; should two share one, both are candidates
    together. Equal rows are one document, reduced before the shuffle.
    """
    segments = max(1, -(-scanned.count() // segment_docs))
    rows = scanned.select(F.xxhash64("key").alias("doc"), F.explode("grams").alias("gram"))
    segment = F.pmod(F.col("doc"), F.lit(segments)).alias("segment")
    return rows.groupBy(segment, "gram").agg(F.sort_array(F.collect_set("doc")).alias("docs"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc and the numbers of the rules whose queries its trigrams answer.

    All postings of a segment meet in one row, where "and" intersects and "or" unites them.
    """
    places = {t: i for i, t in enumerate(query_trigrams(rules))}
    none = F.expr("CAST(array() AS array<bigint>)")

    def answer(rule: Rule) -> Column:
        clauses = [
            reduce(F.array_intersect, [F.coalesce(F.get("lists", F.lit(places[t])), none) for t in sorted(clause)])
            for clause in sorted(trigram_query(rule.pattern), key=sorted)
        ]
        return reduce(F.array_union, clauses)

    answers = [
        F.struct(F.lit(n).alias("rule"), answer(rule).alias("docs")) for n, rule in enumerate(rules) if is_indexed(rule)
    ]
    if not answers:
        return index.select(F.lit(0).cast("bigint").alias("doc"), F.expr("array(0)").alias("rules")).limit(0)
    entries = F.map_from_entries(F.collect_list(F.struct("gram", "docs")))
    # Trigrams that no document of the segment holds have no list.
    lists = F.transform(F.sequence(F.lit(0), F.lit(len(places) - 1)), lambda i: F.element_at("entries", i))
    segments = index.groupBy("segment").agg(entries.alias("entries")).select(lists.alias("lists"))
    answered = segments.select(F.inline(F.array(*answers))).select("rule", F.explode("docs").alias("doc"))
    return answered.groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def verified(docs: DataFrame, found: DataFrame, rules: list[Rule]) -> DataFrame:
    """key and the matches in candidate documents, of the rules that they are candidates for."""
    text = F.col("text")
    rows = _rows(docs).withColumn("doc", F.xxhash64("key")).join(found, "doc")
    matched = [
        F.when(F.array_contains("rules", n) & text.rlike(rule.pattern), _pieces(text, rule, n)).otherwise(_no_pieces())
        for n, rule in enumerate(rules)
        if is_indexed(rule)
    ]
    return rows.select("key", F.concat(*matched).alias("pieces"))


def spans_of(pieces: DataFrame) -> DataFrame:
    """key and its spans, as an array of (start, rule number, end) in that order."""
    exploded = pieces.select("key", F.posexplode("pieces").alias("place", "p")).select("key", "place", "p.*")
    # Equal rows have equal pieces; after the last match there is only a gap.
    rows = exploded.where("size IS NOT NULL").distinct().repartition("key")
    order = Window.partitionBy("key", "number").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("size")).over(order)).where("held")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "number", "end")
    return ended.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """One row per document: doc_id and the spans of all rules' matches.

    ``spans`` is an array of (start, number of the rule, end, kind) in that order, in code
    points, end exclusive. Every match of a rule in the whole text is there, however long
    the text is. Null and empty texts have none. Rows with null or repeated ids are told apart by their text;
    equal rows get one result row each. Columns other than doc_id and text are not looked
    at. An empty table gives no rows.
    """
    scanned = keep(scan_texts(docs, rules), "scanned")
    index = keep(posting_lists(scanned, segment_docs), "index")
    found = keep(candidates(index, rules), "candidates")
    pieces = scanned.select("key", "pieces").where(F.size("pieces") > 0)
    if any(map(is_indexed, rules)):
        # Few documents are candidates: Spark sends them to the texts if their table is small.
        pieces = pieces.unionByName(verified(docs, found, rules))
    spans = keep(spans_of(pieces), "spans")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    none = F.expr("CAST(array() AS array<struct<start:bigint,number:int,end:bigint>>)")
    named = F.transform(
        F.coalesce("spans", none),
        lambda s: F.struct(s["start"], s["number"], s["end"], F.get(kinds, s["number"]).alias("kind")),
    )
    return scanned.select("doc_id", "key").join(spans, "key", "left").select("doc_id", named.alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(number: int) -> Column:
        hits = F.size(F.filter("spans", lambda s: s["number"] == number))
        return hits.cast("bigint").alias(f"n_{BASE_RULES[number].kind}")

    base = F.filter("spans", lambda s: s["number"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *[count(n) for n in range(len(BASE_RULES))],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
