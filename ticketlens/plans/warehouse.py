"""From ticket files to stored tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import expressions as X
from ticketlens.operators.labeling import Labeler, attach_labels, label_tickets, labels_of, unlabelled
from ticketlens.operators.packed_texts import TEXT_GROUP, TEXT_KEY, text_apart, without_text
from ticketlens.operators.quality import build_report, label_join_accounting
from ticketlens.operators.filters import apply_filters
from ticketlens.operators.summaries import newest_months, ticket_explorer
from ticketlens.plans.overview import merged_cells, signed_cells, summary_cells
from ticketlens.plans.models import fact, insights, quarantine, staging, staging_sql
from ticketlens.plans.narrative import NarrativeWriter, write_narrative
from ticketlens.schemas import (
    CELLS_TABLE,
    FACT_TABLE,
    INSIGHTS_TABLE,
    LABEL_FIELDS,
    LABELS_TABLE,
    MALFORMED_TABLE,
    NARRATIVE_TABLE,
    QUALITY_TABLE,
    QUARANTINE_TABLE,
    RAW_COLUMNS,
    RAW_TABLE,
    STAGING_VIEW,
    TEXTS_TABLE,
)
from ticketlens.session import scratch_folder, session_conf, stage
from ticketlens.sources.tables import (
    Snapshot,
    append_narrative,
    append_table,
    latest_narrative,
    publish_view,
    replace_table,
    reset_narratives,
    row_count,
)
from ticketlens.sources.ticket_csv import malformed, read_ticket_rows, well_formed
from ticketlens.sources.versions import Texts, current_version, expire, publish, switch, texts_of, write_version

#: The labels table: answered labels, whether their batch had failed, and the run of the answer.
STORED_LABELS = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("label_pos", T.IntegerType()),
        *LABEL_FIELDS.fields,
        T.StructField("is_fallback", T.BooleanType()),
        T.StructField("run", T.LongType()),
    ]
)

@dataclass(frozen=True)
class LoadReport:
    """What a labelling run did."""

    batches: int
    failed_batches: int
    tickets: int
    labels: int
    raw_rows: int


#: Column that the stored raw rows are laid out by; the published raw table does not show it.
RAW_MONTH = "stored_month"


def raw_month() -> Column:
    """The month of a raw row, whose date is still text; null if that is no date."""
    return X.month_start(X.to_day(F.col("created_at"), True))


def _together(df: DataFrame, month: str) -> DataFrame:
    """Rows of a month in few files, however many tasks wrote them; large months are split."""
    return df.hint("rebalance", F.col(month))


def _file_by_file(spark: SparkSession):
    """Let a task of the scans inside the block read one file, or a piece of a large one.

    Files of long texts are small for what they hold. Writing by month sorts a task's rows, which
    for many files at once would spill their texts.
    """
    return session_conf(spark, spark__sql__files__openCostInBytes=spark.conf.get("spark.sql.files.maxPartitionBytes"))


@dataclass
class Warehouse:
    """The tables by name. ``location`` puts their files below a path of your choice.

    The raw, fact, cell and insight tables are published by version: names switch when a
    build has written everything, and files in use stay. Raw and fact rows are stored by month,
    so that a change, or a view of the newest tickets, touches few months. Where texts repeat,
    the rows of labelled tickets name theirs, and a table of texts that both share holds each
    once; readers of the published names get the texts as ever. ``prefix`` is put before all table names.
    """

    spark: SparkSession
    location: str | None = None
    prefix: str = ""

    def named(self, table: str) -> str:
        return f"{self.prefix}{table}"

    def read_tickets(self, path: str, multi_line: bool = True) -> DataFrame:
        """Ticket files as a columnar copy: labelling and joining read it several times.

        Malformed rows are stored in a table of their own, whose size ``row_counts`` tells.
        """
        rows = stage(read_ticket_rows(self.spark, path, multi_line), "tickets")
        replace_table(malformed(rows), self.named(MALFORMED_TABLE), self.location)
        return well_formed(rows)

    def load_labelled(
        self,
        tickets: DataFrame,
        labeler: Labeler,
        resume: bool = False,
        steps: int = 1,
        max_growth: float | None = None,
        **options,
    ) -> LoadReport:
        """Label tickets into the labels table, and replace the raw table by the join with it.

        Tickets are labelled in ``steps`` parts by a hash of the id, and each part's answers
        are appended to the labels table before the next is asked for. A run that failed is
        taken up with ``resume``: only tickets without a label are asked for, or whose batch
        had failed. A ticket's newest batch counts. ``options`` go to ``label_tickets``.

        Ids that repeat on both sides multiply rows. With ``max_growth``, a join of more
        rows per ticket is refused before the raw table is touched.
        """
        if not resume:
            replace_table(self.spark.createDataFrame([], STORED_LABELS), self.named(LABELS_TABLE), self.location)
        elif not self.spark.catalog.tableExists(self.named(LABELS_TABLE)):
            resume = False
            replace_table(self.spark.createDataFrame([], STORED_LABELS), self.named(LABELS_TABLE), self.location)
        totals = dict.fromkeys(("batches", "failed_batches", "tickets", "labels"), 0)
        run = self.spark.table(self.named(LABELS_TABLE)).agg(F.coalesce(F.max("run"), F.lit(0))).head()[0]
        for step in range(steps):
            part = tickets.where(F.pmod(F.xxhash64("ticket_id"), F.lit(steps)) == step) if steps > 1 else tickets
            seen = Observation()
            with scratch_folder(self.spark, "answers") as folder:
                asked = part
                if resume:
                    asked = without_text(part, lambda rows: unlabelled(rows, self.labels), "ticket_body", folder=folder)
                answers = label_tickets(asked, labeler, observation=seen, folder=folder, **options)
                stored = labels_of(answers).withColumn("run", F.lit(run + 1 + step).cast("bigint"))
                append_table(stored, self.named(LABELS_TABLE))
            for name in totals:
                totals[name] += seen.get[name]
        if max_growth is not None:
            sizes = {row["measure"]: row["value"] for row in label_join_accounting(tickets, self.labels).collect()}
            if sizes["joined_rows"] > max_growth * sizes["tickets"]:
                raise ValueError(f"ticket ids are not unique, the labels would multiply the tickets: {sizes}")
        with scratch_folder(self.spark, "joined") as folder:
            joined, texts = text_apart(
                tickets, lambda rows: attach_labels(rows, self.labels, folder), "ticket_body", raw_month(), folder
            )
            stored = [*RAW_COLUMNS, raw_month().alias(RAW_MONTH)]
            if texts is None:
                raw = self._publish_raw(joined.select(*stored))
            else:
                held = write_version(texts, self.named(TEXTS_TABLE), self.location, partition=TEXT_GROUP)
                named = _together(joined.select(*stored, TEXT_KEY), RAW_MONTH)
                raw = self._publish_raw(named, Texts(held.table, "ticket_body", TEXT_KEY))
        return LoadReport(**totals, raw_rows=raw.count())

    @property
    def labels(self) -> DataFrame:
        """The labels that count: those of the newest run that answered for a ticket."""
        stored = self.spark.table(self.named(LABELS_TABLE))
        newest = stored.groupBy(F.col("ticket_id").alias("_id")).agg(F.max("run").alias("_run"))
        match = F.col("ticket_id").eqNullSafe(F.col("_id")) & (F.col("run") == F.col("_run"))
        return stored.join(newest, match, "left_semi").drop("run")

    def load_raw(self, raw: DataFrame) -> DataFrame:
        """Store raw rows by month; the one exchange of their texts on the way to the fact table."""
        return self._publish_raw(_together(raw.select(*RAW_COLUMNS, raw_month().alias(RAW_MONTH)), RAW_MONTH))

    def _publish_raw(self, stored: DataFrame, texts: Texts | None = None) -> DataFrame:
        options = {"partition": RAW_MONTH, "shown": RAW_COLUMNS, "texts": texts}
        raw = publish(stored, self.named(RAW_TABLE), self.location, **options)
        self._expire_texts()
        return raw

    def _expire_texts(self) -> None:
        users = (self.named(RAW_TABLE), self.named(FACT_TABLE))
        expire(self.spark, self.named(TEXTS_TABLE), self.location, users=users)

    def _fact_rows(self, stored: DataFrame, lenient: bool) -> DataFrame:
        """Fact rows of raw rows as they are stored, with the keys of texts that they only name."""
        return fact(staging(stored, lenient, tuple(c for c in [TEXT_KEY] if c in stored.columns)))

    def tell(self, writer: NarrativeWriter, lenient: bool = False) -> str:
        """Write and store a narrative on the raw table."""
        text = write_narrative(self.raw, writer, lenient)
        name = self.named(NARRATIVE_TABLE)
        reset_narratives(self.spark, name, self.location)
        append_narrative(self.spark, text, name)
        return text

    def build_models(self, lenient: bool = False) -> dict[str, int]:
        """Staging view, fact, cells, insights and the checks' report; returns all row counts.

        Each reads what the one before stored; insights are sums over the cells, so the fact
        table is scanned once for both. Readers see the models of the last build until all are
        written. With ``lenient``, rows that cannot be cast are kept in the quarantine table
        instead of failing the build.
        """
        raw, raw_name = self.raw, self.named(RAW_TABLE)
        bad = quarantine(raw) if lenient else raw.limit(0)
        stg = staging(raw, lenient)
        stored = self._version(RAW_TABLE)
        options = {"partition": "ticket_month", "shown": fact(stg).columns, "texts": texts_of(self.spark, stored)}
        # Raw rows lie by month already: a task writes few files.
        with _file_by_file(self.spark):
            rows = self._fact_rows(self.spark.table(stored), lenient)
            fct = write_version(rows, self.named(FACT_TABLE), self.location, **options)
        cells = write_version(summary_cells(fct.rows()), self.named(CELLS_TABLE), self.location)
        ins = write_version(insights(cells.rows()), self.named(INSIGHTS_TABLE), self.location)
        replace_table(bad, self.named(QUARANTINE_TABLE), self.location)
        stg = publish_view(stg, self.named(STAGING_VIEW), staging_sql(raw_name, lenient))
        self._switch(fct, cells, ins)
        report = build_report(raw, stg, self.fact, self.insights)
        replace_table(report, self.named(QUALITY_TABLE), self.location)
        return self.row_counts()

    def _switch(self, *versions) -> None:
        switch(*versions)
        for version in versions:
            expire(self.spark, version.name, self.location)
        self._expire_texts()

    def apply_changes(
        self, changed: DataFrame | None = None, removed: DataFrame | None = None, lenient: bool = False
    ) -> list:
        """Bring all models up to date with new, changed and removed raw tickets.

        ``changed`` has raw rows: they replace all rows of their ids, or add to the table.
        ``removed`` has the ids of tickets to leave out. Ids are looked up in the raw table's id
        column alone; beyond that only months that a ticket leaves or enters are read and
        written, all others keep their files. Old versions of the tickets are subtracted from
        the cells and new ones are added, and insights are sums over the cells as ever. All
        names switch at the end. The report of the checks stays that of the last full build.
        Returns the months that were written. Rows without an id are added and replace nothing.
        """
        raw = self.raw
        new = raw.limit(0) if changed is None else changed.select(*RAW_COLUMNS)
        with scratch_folder(self.spark, "changes") as folder:
            new = stage(new.withColumn(RAW_MONTH, raw_month()), "changed", folder)
            ids = new.select("ticket_id")
            if removed is not None:
                ids = ids.unionByName(removed.select("ticket_id"))
            ids = stage(ids.dropna().distinct(), "ids", folder)
            version = self._version(RAW_TABLE)
            stored, texts = self.spark.table(version), texts_of(self.spark, version)
            found = stored.select("ticket_id", RAW_MONTH).join(ids, "ticket_id", "left_semi")
            # One row per month of the table, at most.
            months = sorted({r[0] for r in found.select(RAW_MONTH).unionByName(new.select(RAW_MONTH)).distinct().collect()}, key=str)
            if not months:
                return []
            known = [m for m in months if m is not None]
            touched = F.col(RAW_MONTH).isin(known) if known else F.lit(False)
            touched = touched | F.col(RAW_MONTH).isNull() if None in months else touched
            old = stored.where(touched)
            gone = stage(old.join(ids, "ticket_id", "left_semi"), "gone", folder)
            # Rows that are new hold their own texts.
            rows = old.join(ids, "ticket_id", "left_anti").unionByName(new, allowMissingColumns=True)
            texts = self._texts_still_named(texts, stored, ids, gone, folder)
            options = {"location": self.location, "replaced": months, "texts": texts}
            raw_version = write_version(
                _together(rows, RAW_MONTH), self.named(RAW_TABLE), partition=RAW_MONTH, shown=RAW_COLUMNS, **options
            )
            # A raw row's month is its fact row's month, so the same months change.
            facts = self._fact_rows(raw_version.rows().where(touched), lenient)
            shown = fact(staging(raw, lenient)).columns
            with _file_by_file(self.spark):
                fct = write_version(facts, self.named(FACT_TABLE), partition="ticket_month", shown=shown, **options)
            delta = self._cells_of(new, lenient, 1).unionByName(self._cells_of(gone, lenient, -1))
            cells = write_version(merged_cells(self.cells.unionByName(delta)), self.named(CELLS_TABLE), self.location)
            ins = write_version(insights(cells.rows()), self.named(INSIGHTS_TABLE), self.location)
            if lenient:
                bad = self.spark.table(self.named(QUARANTINE_TABLE)).join(ids, "ticket_id", "left_anti")
                bad = stage(bad.unionByName(quarantine(new.drop(RAW_MONTH))), "bad", folder)
                replace_table(bad, self.named(QUARANTINE_TABLE), self.location)
            self._switch(raw_version, fct, cells, ins)
        return months

    def _texts_still_named(
        self, texts: Texts | None, stored: DataFrame, ids: DataFrame, gone: DataFrame, folder: str
    ) -> Texts | None:
        """The texts without those that only rows that go have named; months that hold none of these keep their files."""
        if texts is None:
            return None
        left = stored.where(F.col(TEXT_KEY).isNotNull()).select("ticket_id", TEXT_KEY)
        unnamed = gone.select(TEXT_KEY).dropna().distinct()
        left = left.join(unnamed, TEXT_KEY, "left_semi").join(ids, "ticket_id", "left_anti")
        unnamed = unnamed.join(left, TEXT_KEY, "left_anti")
        held = self.spark.table(texts.table)
        unnamed = stage(held.select(TEXT_KEY, TEXT_GROUP).join(unnamed, TEXT_KEY, "left_semi"), "unnamed_texts", folder)
        # One row per month of the table, at most.
        months = [row[0] for row in unnamed.select(TEXT_GROUP).distinct().collect()]
        if not months:
            return texts
        touched = F.lit(False)
        for month in months:
            touched = touched | F.col(TEXT_GROUP).eqNullSafe(F.lit(month))
        kept = _together(held.where(touched).join(unnamed.select(TEXT_KEY), TEXT_KEY, "left_anti"), TEXT_GROUP)
        options = {"partition": TEXT_GROUP, "replaced": months, "before": texts.table}
        return replace(texts, table=write_version(kept, self.named(TEXTS_TABLE), self.location, **options).table)

    def _cells_of(self, rows: DataFrame, lenient: bool, sign: int) -> DataFrame:
        return signed_cells(summary_cells(fact(staging(rows.drop(RAW_MONTH), lenient))), sign)

    def _version(self, table: str) -> str:
        found = current_version(self.spark, self.named(table))
        if found is None:
            raise ValueError(f"{self.named(table)} has not been loaded by this warehouse")
        return found

    def row_counts(self) -> dict[str, int]:
        """Rows of every table that exists."""
        names = [MALFORMED_TABLE, LABELS_TABLE, RAW_TABLE, QUARANTINE_TABLE, FACT_TABLE, CELLS_TABLE, INSIGHTS_TABLE]
        known = [n for n in names if self.spark.catalog.tableExists(self.named(n))]
        return {n: row_count(self.spark, self.named(n)) for n in known}

    @property
    def quality(self) -> DataFrame:
        return self.spark.table(self.named(QUALITY_TABLE))

    @property
    def raw(self) -> DataFrame:
        return self.spark.table(self.named(RAW_TABLE))

    @property
    def staging(self) -> DataFrame:
        return self.spark.table(self.named(STAGING_VIEW))

    @property
    def models(self) -> dict[str, DataFrame]:
        """The models that users query, by name."""
        return {n: self.spark.table(self.named(n)) for n in (RAW_TABLE, STAGING_VIEW, FACT_TABLE, INSIGHTS_TABLE)}

    @property
    def fact(self) -> DataFrame:
        return self.spark.table(self.named(FACT_TABLE))

    @property
    def insights(self) -> DataFrame:
        return self.spark.table(self.named(INSIGHTS_TABLE))

    @property
    def cells(self) -> DataFrame:
        return self.spark.table(self.named(CELLS_TABLE))

    def cached_cells(self, ttl: float = 60.0) -> Snapshot:
        """The cells kept in memory or on disk, read anew when older than ``ttl`` seconds."""
        return Snapshot(self.spark, self.named(CELLS_TABLE), ttl=ttl)

    def newest_tickets(self, n: int = 100, **filters: str) -> DataFrame:
        """The explorer of the stored fact table, which reads only the months that it needs."""
        shown = apply_filters(self.cells, **filters)
        return ticket_explorer(newest_months(apply_filters(self.fact, **filters), shown, n), n)

    @property
    def narrative(self) -> DataFrame:
        return latest_narrative(self.spark, self.named(NARRATIVE_TABLE))
