"""Tables published by version: a reader sees the old rows or the new ones, never a mix or a gap.

Every build writes new folders and a new table over them; no written file is ever changed.
The public name is a view on the current version, switched when all is written. A version
that replaces some partitions only takes the folders of all others from the one before, so
they are neither read nor copied. Frames that were made before a switch keep reading the old
folders, which go when no kept or leased version uses them.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ticketlens.session import shuffles_dropped

#: Versions that stay after a switch: the new one, and the one that readers may be at.
KEPT_VERSIONS = 2
#: Compression of the files. Texts take less than two thirds of what Spark's default makes of them, and large
#: pages at this level, in a build that keeps them twice, a twelfth less than small ones at zstd's own level.
FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(8 << 20)}
_CURRENT, _LEASE, _TEXTS = "ticketlens.current", "ticketlens.lease.", "ticketlens.texts"


@dataclass(frozen=True)
class Texts:
    """A stored table of texts, ``text`` by ``key``, that rows of other tables name by their column ``key``."""

    table: str
    text: str
    key: str


@dataclass(frozen=True)
class Version:
    """A written version of a table, which readers do not see before ``switch``.

    With ``texts`` readers get the column of that name from there, for rows that have a key.
    """

    spark: SparkSession
    name: str
    table: str
    shown: tuple[str, ...]
    texts: Texts | None = None

    def rows(self) -> DataFrame:
        """The rows as they are stored: without the texts that they only name."""
        return self.spark.table(self.table)


def _shown_sql(table: str, shown: Iterable[str], texts: Texts | None) -> str:
    """What readers get of a stored table.

    Texts are grouped by their key, so that Spark knows it to be unique and leaves the join out
    for readers of other columns. Rows that hold their own text, or none, get keys of their own
    there, shorter than any, so that they spread.
    """
    if texts is None:
        return f"SELECT {', '.join(f'`{c}`' for c in shown)} FROM {table}"
    shown, key = list(shown), texts.key
    columns = ", ".join(f"coalesce(r.`{c}`, t.`{c}`) AS `{c}`" if c == texts.text else f"r.`{c}`" for c in shown)
    own = ", ".join(f"r.`{c}`" for c in shown if c != texts.text)
    return (
        f"SELECT {columns} FROM {table} r LEFT JOIN "
        f"(SELECT `{key}`, max(`{texts.text}`) AS `{texts.text}` FROM {texts.table} GROUP BY `{key}`) t "
        f"ON coalesce(r.`{key}`, unhex(lpad(hex(xxhash64({own})), 16, '0'))) = t.`{key}`"
    )


def _told(spark: SparkSession, table: str) -> dict[str, str]:
    return {row["key"]: row["value"] for row in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}


def texts_of(spark: SparkSession, table: str) -> Texts | None:
    """The texts that the rows of a version's table name; none if they hold their own."""
    found = _told(spark, table).get(_TEXTS)
    return Texts(*found.split("\t")) if found else None


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _root(spark: SparkSession, name: str, location: str | None) -> str:
    base = location or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def _folders(spark: SparkSession, path: str) -> list[str]:
    files, target = _files(spark, path)
    if not files.exists(target):
        return []
    return [s.getPath().toString() for s in files.listStatus(target) if s.isDirectory()]


#: File in a version's folder that tells the folder of each of its partitions.
_PLACES = "_places"


def _stamp(table: str) -> str:
    return table.rsplit("__v", 1)[1]


def _save_partitions(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    files, target = _files(spark, f"{path}/{_PLACES}")
    stream = files.create(target, True)
    stream.write(bytearray("".join(f"{k}\t{v}\n" for k, v in sorted(folders.items())).encode()))
    stream.close()


def _partitions(spark: SparkSession, root: str, table: str) -> dict[str, str]:
    """The folder of every partition of a version, by ``column=value``; empty if it has no partitions."""
    files, target = _files(spark, f"{root}/{_stamp(table)}/{_PLACES}")
    if not files.exists(target):
        return {}
    stream = files.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return dict(line.split("\t") for line in text.splitlines())


def _spec(folder: str) -> str:
    column, _, value = folder.partition("=")
    return f"{column} = NULL" if value == "__HIVE_DEFAULT_PARTITION__" else f"{column} = {_quoted(value)}"


def current_version(spark: SparkSession, name: str) -> str | None:
    """The table behind a published name; none if the name is not published by version."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType != "VIEW":
        return None
    return _told(spark, name).get(_CURRENT)


def write_version(
    df: DataFrame,
    name: str,
    location: str | None = None,
    partition: str | None = None,
    replaced: Iterable | None = None,
    shown: Iterable[str] | None = None,
    texts: Texts | None = None,
    before: str | None = None,
) -> Version:
    """Write ``df`` as the next version of ``name``.

    ``partition`` is a date column. With ``replaced``, values of it, these partitions are
    replaced by those of ``df`` (or end, if it has none), and all others stay as they are in
    the version ``before``, the current one if not given. ``shown`` are the columns that the published name has, if not all. With
    ``texts``, rows of ``df`` that have a key there come without their text.
    """
    spark = df.sparkSession
    stamp = f"{time.time_ns():016x}{uuid.uuid4().hex[:4]}"
    path, table = f"{_root(spark, name, location)}/{stamp}", f"{name}__v{stamp}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    by = f" PARTITIONED BY (`{partition}`)" if partition else ""
    # Before the files: another build that tidies up leaves the folders of known versions alone.
    told = f" TBLPROPERTIES ('{_TEXTS}' = '{texts.table}\t{texts.text}\t{texts.key}')" if texts else ""
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{by} LOCATION {_quoted(path)}{told}")
    writer = df.write.partitionBy(partition) if partition else df.write
    with shuffles_dropped(spark):
        writer.mode("append").options(**FILES).parquet(path)
    if partition:
        folders = {}
        if replaced is not None:
            gone = {f"{partition}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for v in replaced}
            before = before or current_version(spark, name)
            known = _partitions(spark, _root(spark, name, location), before) if before else {}
            folders = {k: v for k, v in known.items() if k not in gone}
        folders |= {f.rsplit("/", 1)[1]: f for f in _folders(spark, path) if "=" in f.rsplit("/", 1)[1]}
        if folders:
            places = " ".join(f"PARTITION ({_spec(k)}) LOCATION {_quoted(v)}" for k, v in sorted(folders.items()))
            spark.sql(f"ALTER TABLE {table} ADD {places}")
        _save_partitions(spark, path, folders)
    return Version(spark, name, table, tuple(shown or df.columns), texts)


def switch(*versions: Version) -> None:
    """Let the published names show these versions. Each name changes at once and whole."""
    for v in versions:
        spark = v.spark
        if spark.catalog.tableExists(v.name) and spark.catalog.getTable(v.name).tableType != "VIEW":
            spark.sql(f"DROP TABLE {v.name}")
        rows = _shown_sql(v.table, v.shown, v.texts)
        spark.sql(f"CREATE OR REPLACE VIEW {v.name} TBLPROPERTIES ('{_CURRENT}' = '{v.table}') AS {rows}")


def publish(df: DataFrame, name: str, location: str | None = None, **options) -> DataFrame:
    """Write a version, switch to it, and let go of old ones."""
    version = write_version(df, name, location, **options)
    switch(version)
    expire(version.spark, name, location)
    return version.spark.table(name)


@contextmanager
def leased(spark: SparkSession, name: str, seconds: float = 3600.0) -> Iterator[DataFrame]:
    """The current version as a frame whose files stay for the block, or until the lease ends."""
    table = current_version(spark, name)
    if table is None:
        yield spark.table(name)
        return
    key = f"{_LEASE}{uuid.uuid4().hex}"
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{key}' = '{time.time() + seconds}')")
    texts = texts_of(spark, table)
    try:
        columns = [c for c in spark.table(table).columns if texts is None or c != texts.key]
        yield spark.sql(_shown_sql(table, columns, texts))
    finally:
        if spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('{key}')")


def _is_leased(spark: SparkSession, table: str) -> bool:
    return any(k.startswith(_LEASE) and float(v) > time.time() for k, v in _told(spark, table).items())


def versions_of(spark: SparkSession, name: str) -> list[str]:
    """The tables of all versions, oldest first; a version that was never switched to is among them."""
    return sorted(row["tableName"] for row in spark.sql(f"SHOW TABLES LIKE '{name}__v*'").collect())


def expire(
    spark: SparkSession, name: str, location: str | None = None, kept: int = KEPT_VERSIONS, users: Iterable[str] = ()
) -> None:
    """Drop versions older than the newest ``kept`` that are neither current nor leased, and their files.

    Of a table of texts, those stay that rows of a version of one of the tables ``users`` name.
    """
    tables, current = versions_of(spark, name), current_version(spark, name)
    old = [t for t in tables[: max(0, len(tables) - kept)] if t != current and not _is_leased(spark, t)]
    if old and users:
        named = {found.table for user in users for v in versions_of(spark, user) if (found := texts_of(spark, v))}
        old = [t for t in old if t not in named]
    if not old:
        return
    root = _root(spark, name, location)
    used: set[str] = set()
    for table in tables:
        if table not in old:
            used |= {_stamp(table), *map(_tail, _partitions(spark, root, table).values())}
    for table in old:
        spark.sql(f"DROP TABLE {table}")
    for folder in _folders(spark, root):
        if _tail(folder) in used:
            continue
        parts = _folders(spark, folder)
        gone = [p for p in parts if _tail(p) not in used]
        for path in [folder] if len(gone) == len(parts) else gone:
            files, target = _files(spark, path)
            files.delete(target, True)


def _tail(path: str) -> str:
    """A version's folder by its stamp, or a partition's by stamp and value."""
    parts = path.rstrip("/").split("/")
    return "/".join(parts[-2:] if "=" in parts[-1] else parts[-1:])
