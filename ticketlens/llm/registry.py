"""The queries over the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (
    common,
    decontamination,
    exact_dedup,
    filter_audit,
    html_extraction,
    license_scan,
    merkle_manifest,
    ngram_join,
    packing,
    personal_data,
    secret_scan,
    sharding,
    substring_dedup,
    toxicity,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return common.read_table(spark, sf_dir, "documents")


def word_vocabulary() -> str:
    """Path of the public vocabulary that the packing query counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(_documents(spark, sf_dir))
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", kept)


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digest(personal_data.find_personal_data(_documents(spark, sf_dir)))


def op3_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return html_extraction.extract_text(common.read_table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return decontamination.find_contaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), word_vocabulary())


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table has no paths: a source is a tree with a folder per language.
    docs = _documents(spark, sf_dir)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return license_scan.license_scan(files).withColumnRenamed("id", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_documents(spark, sf_dir))


def op11_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.find_secrets(_documents(spark, sf_dir)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle_manifest.merkle_manifest(docs, changed)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_documents(spark, sf_dir), common.read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_bootstrapped_pii": op2_bootstrapped_pii,
        "op3_wrapper_extraction": op3_wrapper_extraction,
        "op4_benchmark_decontamination": op4_benchmark_decontamination,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_feistel_shards": op6_feistel_shards,
        "op7_license_scan": op7_license_scan,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_weak_toxicity": op9_weak_toxicity,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_trigram_secrets": op11_trigram_secrets,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op4_benchmark_decontamination": OP4_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op10_ngram_jaccard_join": OP10_SQL,
        "op11_trigram_secrets": op11_sql(),
        "op12_merkle_manifest": OP12_SQL,
        "op13_filter_audit": OP13_SQL,
    }


OP8_SQL = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS len,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""

OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word, w FROM d),
windows AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) > 1 AS again
    FROM words WHERE p + 19 <= len(w)
),
marked AS (
    SELECT doc_id, p, word, bool_or(coalesce(again, false))
           OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM words LEFT JOIN windows USING (doc_id, p)
),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
           string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept
    FROM marked GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

OP4_SQL = f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
tests AS (
    SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM i)
),
d AS (SELECT doc_id, w, size FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT size FROM i)),
found AS (
    SELECT DISTINCT doc_id, size, array_to_string(w[p:p + size - 1], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM d WHERE len(w) >= size)
),
met AS (SELECT doc_id, item_id, count(*) AS shared FROM tests JOIN found USING (size, shingle) GROUP BY ALL),
sizes AS (SELECT item_id, count(*) AS item_shingles FROM tests GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM met JOIN sizes USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
met AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""


def op11_sql() -> str:
    """Positions from the gaps between matches; every rule against every text."""

    def matches(number: int, rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
    SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least,
           regexp_split_to_array(t, '{pattern}') AS gaps,
           regexp_extract_all(t, '{pattern}', 0) AS found,
           regexp_extract_all(t, '{pattern}', {rule.group}) AS sized
    FROM d WHERE regexp_matches(t, '{pattern}')"""

    rules = "\n    UNION ALL".join(matches(n, r) for n, r in enumerate(secret_scan.RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
met AS ({rules}
),
pieces AS (
    SELECT doc_id, number, kind, least, p, length(gaps[p]) AS gap, length(found[p]) AS size, length(sized[p]) AS sized
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS p FROM met)
),
placed AS (
    SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, number ORDER BY p) AS stop FROM pieces
),
spans AS (
    SELECT doc_id, number, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span, stop - size AS start
    FROM placed WHERE sized >= least
),
listed AS (
    SELECT doc_id, count(*) FILTER (WHERE number = 0) AS n_assign, count(*) FILTER (WHERE number = 1) AS n_access,
           count(*) FILTER (WHERE number = 2) AS n_hex,
           string_agg(span, ',' ORDER BY start, number) FILTER (WHERE number < {len(secret_scan.BASE_RULES)}) AS base,
           string_agg(span, ',' ORDER BY start, number) AS spans
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", f"{n_chars}::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


# Trees by levels: a node's number is halved from one level to the next. Numbers of trees
# follow the languages; the dataset's own tree has number 0 and the trees' roots as leaves.
OP12_SQL = f"""
WITH RECURSIVE sums(doc_id, digits, k, crc) AS (
    SELECT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT doc_id, digits, k + 1,
           CASE WHEN k % 9 = 0 THEN xor(crc, ascii(digits[k // 9 + 1])::BIGINT)
                WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END
    FROM sums WHERE k < 9 * length(digits)
),
crcs AS (SELECT doc_id, xor(crc, 4294967295) AS crc FROM sums WHERE k = 9 * length(digits)),
leaves AS (
    SELECT doc_id, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS changed, crc % 7 = 0 AS tampered,
           dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
    FROM documents LEFT JOIN crcs USING (doc_id)
),
nodes(tree, level, pos, hash, size) AS (
    SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
    UNION ALL
    SELECT a.tree, a.level + 1, a.pos // 2, sha256(a.hash || coalesce(b.hash, '')), (a.size + 1) // 2
    FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND b.pos = a.pos + 1
    WHERE a.pos % 2 = 0 AND a.size > 1
),
subroots AS (SELECT tree, level AS height, hash FROM nodes WHERE size = 1),
tops(level, pos, hash, size) AS (
    SELECT 0, tree - 1, hash, count(*) OVER () FROM subroots
    UNION ALL
    SELECT a.level + 1, a.pos // 2, sha256(a.hash || coalesce(b.hash, '')), (a.size + 1) // 2
    FROM tops a LEFT JOIN tops b ON a.level = b.level AND b.pos = a.pos + 1
    WHERE a.pos % 2 = 0 AND a.size > 1
),
root AS (SELECT level AS height, hash FROM tops WHERE size = 1),
all_nodes AS (
    SELECT tree, level, pos, hash FROM nodes UNION ALL SELECT 0, level, pos, hash FROM tops
),
path AS (
    SELECT l.doc_id, h.level AS turn, n.hash AS other, (l.pos // (2 ** h.level)::BIGINT) % 2 = 1 AS other_first
    FROM leaves l JOIN subroots s USING (tree), LATERAL (SELECT unnest(range(s.height)) AS level) h
    LEFT JOIN all_nodes n ON n.tree = l.tree AND n.level = h.level AND n.pos = xor(l.pos // (2 ** h.level)::BIGINT, 1)
    UNION ALL
    SELECT l.doc_id, s.height + h.level, n.hash, ((l.tree - 1) // (2 ** h.level)::BIGINT) % 2 = 1
    FROM leaves l JOIN subroots s USING (tree), root r, LATERAL (SELECT unnest(range(r.height)) AS level) h
    LEFT JOIN all_nodes n ON n.tree = 0 AND n.level = h.level AND n.pos = xor((l.tree - 1) // (2 ** h.level)::BIGINT, 1)
),
folds(doc_id, turn, hash) AS (
    SELECT doc_id, 0::BIGINT, CASE WHEN tampered THEN changed ELSE leaf END FROM leaves
    UNION ALL
    SELECT f.doc_id, f.turn + 1,
           sha256(CASE WHEN other_first THEN coalesce(other, '') || hash ELSE hash || coalesce(other, '') END)
    FROM folds f JOIN path p ON p.doc_id = f.doc_id AND p.turn = f.turn
),
proofs AS (SELECT doc_id, string_agg(other, '' ORDER BY turn) AS proof FROM path GROUP BY doc_id)
SELECT l.doc_id, leaf, s.hash AS subroot, r.hash AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       f.hash AS folded_root, f.hash = r.hash AS verified
FROM leaves l JOIN subroots s USING (tree), root r, folds f LEFT JOIN proofs p ON p.doc_id = f.doc_id
WHERE f.doc_id = l.doc_id AND f.turn = s.height + r.height
"""

OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
failed AS (
    SELECT doc_id, part,
           CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM d
),
cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
    FROM failed LEFT JOIN labels USING (doc_id) GROUP BY part, mask
),
bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM bits a, bits b, bits c, bits d, bits e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
),
steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
    FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
),
counted AS (
    SELECT part, filter_order, step::INTEGER AS step, any_value(bit) AS bit,
           coalesce(sum(n) FILTER (WHERE mask & (before + bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM counted
"""
