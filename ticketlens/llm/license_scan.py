"""Licences of files: TF-IDF cosine to templates, then the nearest ancestor directory.

Lines of a file (headers) and whole files (licence files) are sparse TF-IDF vectors; their
cosine to templates of known licences names their licence. Terms are weighted by how few
documents of the whole corpus have them. A file without an own licence takes that of the
nearest ancestor directory with a licence file, found by joins on directory paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import in_pieces, keep, split_words, whole_text, word_codes

#: Short headers of common licences; a caller may pass templates of its own, full texts too.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
}
#: Cosine from which a line, or a whole file, carries a licence.
HEADER_COSINE, FILE_COSINE = 0.8, 0.5

_TRIM = ".,;:!?\"'()[]{}<>*#/-"


def _term(word: str) -> str:
    return word.lower().strip(_TRIM)


class Templates:
    """Terms and unit vectors of the templates."""

    def __init__(self, templates: dict[str, str], weight: dict[str, float] | None = None, unseen: float = 1.0):
        self.names = sorted(templates)
        counts = [self._counts(templates[n]) for n in self.names]
        self.terms = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        self.unseen = unseen
        self.weight = np.array([(weight or {}).get(t, unseen) for t in self.terms])
        rows = np.zeros((len(self.names), len(self.terms)))
        for k, c in enumerate(counts):
            for t, n in c.items():
                rows[k, self.terms[t]] = n * self.weight[self.terms[t]]
        self.vectors = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)

    @staticmethod
    def _counts(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for word in text.split():
            if _term(word):
                out[_term(word)] = out.get(_term(word), 0) + 1
        return out

    def best(self, group: np.ndarray, code: np.ndarray, term: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The most similar template of each group of words and its cosine.

        ``code`` tells words apart, ``term`` is a template term's number or -1.
        """
        dots = np.zeros((groups, len(self.names)))
        known = term >= 0
        # Only groups with a template term can be similar to one.
        for k in range(len(self.names)):
            value = self.weight[term[known]] * self.vectors[k][term[known]]
            dots[:, k] = np.bincount(group[known], value, minlength=groups)
        norm = np.zeros(groups)
        touched = np.flatnonzero(dots.max(axis=1) > 0) if len(self.names) else np.zeros(0, np.int64)
        keep = np.isin(group, touched)
        key, times = np.unique(np.stack([group[keep], np.where(known[keep], term[keep], len(self.terms) + code[keep])]), axis=1, return_counts=True)
        if key.size:
            inside = key[1] < len(self.terms)
            w = np.where(inside, np.append(self.weight, 0)[np.minimum(key[1], len(self.terms))], self.unseen)
            norm = np.sqrt(np.bincount(key[0], (times * w) ** 2, minlength=groups))
        cosine = dots / np.maximum(norm, 1e-12)[:, None]
        if not len(self.names):
            return np.zeros(groups, np.int64), np.zeros(groups)
        return cosine.argmax(axis=1), cosine.max(axis=1)


def term_weights(docs: DataFrame, templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the template terms over all documents, and of an unseen one."""
    terms = Templates(templates).terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(terms), np.int64)
        for batch in in_pieces(batches, "text"):
            words, starts = split_words(batch.column("text"))
            codes, distinct = word_codes(words)
            table = np.array([terms.get(_term(w), -1) for w in distinct], np.int64)
            term = table[codes] if len(codes) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            pairs = np.unique(doc[term >= 0] * len(terms) + term[term >= 0])
            seen += np.bincount(pairs % max(1, len(terms)), minlength=len(terms))
            total += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(len(terms)), -1]), pa.array([*seen.tolist(), total])], ["term", "docs"]
        )

    parts = docs.select(whole_text().alias("text")).mapInArrow(count, "term bigint, docs bigint")
    # One row per template term.
    found = dict(parts.groupBy("term").agg(F.sum("docs").alias("docs")).collect())
    total = found.get(-1, 0)
    idf = lambda n: float(np.log((1 + total) / (1 + n)) + 1)
    return {t: idf(found.get(i, 0)) for t, i in terms.items()}, idf(0)


def own_licenses(files: DataFrame, templates: dict[str, str]) -> DataFrame:
    """path, header and file licences with their cosines, per row of ``files`` (path, text)."""
    weight, unseen = term_weights(files, templates)
    known = Templates(templates, weight, unseen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text"):
            lines = pc.split_pattern_regex(batch.column("text"), r"[\r\n]")
            first = lines.offsets.to_numpy() - lines.offsets.to_numpy()[0]
            words, starts = split_words(lines.flatten())
            codes, distinct = word_codes(words)
            terms = [_term(w) for w in distinct]
            same: dict[str, int] = {}
            code = np.array([same.setdefault(t, len(same)) for t in terms], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            table = np.array([known.terms.get(t, -1) for t in terms], np.int64)
            term = table[codes] if len(codes) else np.zeros(0, np.int64)
            word = np.array([bool(t) for t in terms], bool)[codes] if len(codes) else np.zeros(0, bool)
            line = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            doc_of_line = np.repeat(np.arange(batch.num_rows), np.diff(first))
            name, cosine = known.best(line[word], code[word], term[word], len(starts) - 1)
            doc = doc_of_line[line] if len(line) else line
            whole, file_cosine = known.best(doc[word], code[word], term[word], batch.num_rows)
            # The most similar line of each file, the first of equals.
            order = np.lexsort((np.arange(len(name)), -cosine, doc_of_line))
            top = order[np.searchsorted(doc_of_line[order], np.arange(batch.num_rows))]
            pick = lambda k, c, least: [known.names[i] if x >= least else None for i, x in zip(k, c)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("path"),
                    pa.array(pick(name[top], cosine[top], HEADER_COSINE), pa.string()),
                    pa.array(cosine[top]),
                    pa.array(pick(whole, file_cosine, FILE_COSINE), pa.string()),
                    pa.array(file_cosine),
                ],
                ["id", "path", "header", "header_cosine", "whole", "whole_cosine"],
            )

    rows = files.select("id", "path", whole_text().alias("text"))
    return rows.mapInArrow(
        scan, "id bigint, path string, header string, header_cosine double, whole string, whole_cosine double"
    )


def directory_of(path: Column) -> Column:
    """All of a path before its last slash; empty for none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """A directory and all those above it, the root (empty) included."""
    parts = F.split(directory, "/")
    all_of = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(all_of, F.array(F.lit(""))))


def license_scan(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per file: id, path, license, cosine, how, license_directory.

    ``how`` is ``header`` (a line of the file is like a template), ``file`` (its whole text
    is, so it licences its directory, too), ``inherited`` or ``none``. A directory with
    several licence files takes the most similar, then the first by name. A null path counts
    as empty, in the root directory; null and empty texts carry nothing and may inherit;
    repeated rows give repeated results; an empty table gives no rows.
    """
    rows = files.select("id", F.coalesce("path", F.lit("")).alias("path"), "text")
    own = keep(own_licenses(rows, templates), "own")
    directory = directory_of(F.col("path"))
    best = F.max(F.struct(F.col("whole_cosine").alias("cosine"), F.col("whole").alias("license"))).alias("best")
    licensed = own.where("whole IS NOT NULL").groupBy(directory.alias("at")).agg(best).select("at", "best.license", "best.cosine")
    # Directories are joined with their ancestors, not files: a large one is one row.
    directories = own.select(directory.alias("directory")).distinct()
    above = directories.select("directory", F.explode(_ancestors(F.col("directory"))).alias("at"))
    nearest = (
        above.join(licensed, "at")
        .groupBy("directory")
        .agg(F.max(F.struct(F.length("at").alias("depth"), "at", "license", "cosine")).alias("n"))
        .select("directory", F.col("n.at").alias("at"), F.col("n.license").alias("inherited"), F.col("n.cosine").alias("inherited_cosine"))
    )
    joined = own.withColumn("directory", directory).join(nearest, "directory", "left")
    return joined.select(
        "id",
        "path",
        F.coalesce("header", "whole", "inherited").alias("license"),
        F.when(F.col("header").isNotNull(), F.col("header_cosine"))
        .when(F.col("whole").isNotNull(), F.col("whole_cosine"))
        .otherwise(F.col("inherited_cosine"))
        .alias("cosine"),
        F.when(F.col("whole").isNotNull(), "file")
        .when(F.col("header").isNotNull(), "header")
        .when(F.col("inherited").isNotNull(), "inherited")
        .otherwise("none")
        .alias("how"),
        F.when(F.col("header").isNull() & F.col("whole").isNull(), F.col("at")).alias("license_directory"),
    )
