"""Reading, checking and writing tables; the lifecycle of tagged tables; keyed updates."""

from __future__ import annotations

import re
import time
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TAG = re.compile(r"^[a-z_][a-z0-9_]*$")  # fixed: the published rule for tags
PURCHASES = ("household_number", "tpnb", "year_number", "period_number", "week_number", "quantity")


class SchemaError(ValueError):
    """A table lacks columns that an operator needs."""


def read_table(spark: SparkSession, path: str, columns: Iterable[str] = ()) -> DataFrame:
    """A Parquet file or a folder of part files. ``columns`` are required and alone are read."""
    df = spark.read.parquet(path)
    columns = list(columns)
    return require_columns(df, columns, path).select(*columns) if columns else df


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Raise, before any job runs, if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise SchemaError(f"{what} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def valid_tag(tag: str) -> str:
    if not _TAG.match(tag):
        raise ValueError(f"{tag!r} is no tag: lower-case letters, digits and underscores, and no digit first")
    return tag


def create_table(df: DataFrame, name: str, *, bucket_by: str | None = None, buckets: int = 64, sort_by: str | None = None) -> DataFrame:
    """Replace a table in the catalog. Bucketing on the later join key saves that join's shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by:
        writer = writer.bucketBy(buckets, bucket_by)
        writer = writer.sortBy(sort_by or bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop_tag(spark: SparkSession, tag: str, names: Iterable[str]) -> list[str]:
    """Drop the tables ``<name>_<tag>`` of the given names, and no other that happens to end alike."""
    valid_tag(tag)
    there = {t.name for t in spark.catalog.listTables()}
    dropped = [n for n in (f"{valid_tag(name)}_{tag}" for name in names) if n in there]
    for n in dropped:
        spark.sql(f"DROP TABLE IF EXISTS `{n}`")
    return dropped


def register(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(valid_tag(name))
    return name


def load_vectors(df: DataFrame, key: str = "tpnb", column: str = "embedding") -> DataFrame:
    """(key string, embedding array<float>) from lists or comma-separated text. Ragged or empty vectors raise."""
    require_columns(df, (key, column), "vector table")
    kind = df.schema[column].dataType.simpleString()
    v = F.transform(F.split(F.col(column), ","), lambda x: F.trim(x).cast("float")) if kind == "string" else F.col(column).cast("array<float>")
    out = df.select(F.col(key).cast("string").alias(key), v.alias(column))
    low, high = out.agg(F.min(F.coalesce(F.size(column), F.lit(0))), F.max(F.size(column))).first()
    if low is not None and (low != high or low < 1):
        raise SchemaError(f"vectors have from {low} to {high} entries; all must have the same number, at least one")
    return out


def row_range(df: DataFrame, low: int, high: int, column: str = "basket_seq") -> DataFrame:
    """Rows low to high, in order; files sorted by the column let the scan skip row groups."""
    return df.where(F.col(column).between(low, high)).orderBy(column)


def with_chunk(df: DataFrame, chunk_size: int, column: str = "basket_seq") -> DataFrame:
    """chunk_id from 0: partitions replace chunk loops, the number serves resumption."""
    return df.withColumn("chunk_id", F.floor((F.col(column) - 1) / chunk_size).cast("long"))


def chunk_plan(df: DataFrame, chunk_size: int, column: str = "basket_seq") -> DataFrame:
    """chunk_id, seq_lo, seq_hi of every chunk; the last one ends where the rows end."""
    total = df.agg(F.max(column).alias("n"))
    ids = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk_size).cast("long"))).alias("chunk_id"), "n")
    return ids.select("chunk_id", (F.col("chunk_id") * chunk_size + 1).alias("seq_lo"), F.least((F.col("chunk_id") + 1) * chunk_size, F.col("n")).cast("long").alias("seq_hi"))


def claimable(ledger: DataFrame, now: Column, stale_after_seconds: int = 3600) -> DataFrame:
    """Chunks that are pending, or running for too long, the first one first."""
    old = now - F.make_dt_interval(secs=F.lit(stale_after_seconds))
    return ledger.where((F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("updated_at") < old))).orderBy("chunk_id")


class WorkQueue:
    """A restartable queue of chunks in a folder that all workers share: claims and completions are files that are created
    or not as one act, so no chunk has two owners at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
        self._jvm, self._folder = jvm, folder

    def _create(self, name: str) -> bool:
        return self._fs.createNewFile(self._path(name))

    def _state(self) -> dict[int, tuple[str, int, float]]:
        """Of each chunk that was ever claimed: its status, how often it was claimed, and when last (in seconds)."""
        out: dict[int, tuple[str, int, float]] = {}
        for f in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self._folder)):
            m = re.fullmatch(r"chunk-([0-9]+)[.](claim-([0-9]+)|done)", f.getPath().getName())
            if m:
                chunk, status, claims, at = int(m[1]), *out.get(int(m[1]), ("running", 0, 0.0))
                now = f.getModificationTime() / 1000
                out[chunk] = ("complete", claims, at) if m[2] == "done" else (status, max(claims, int(m[3])), max(at, now))
        return out

    def claim(self, chunks: Iterable[int], stale_after_seconds: float = 3600, now: float | None = None) -> int | None:
        """The lowest chunk that is pending, or whose claim is too old, for the caller alone; None if there is none."""
        state, now = self._state(), time.time() if now is None else now
        for chunk in sorted(chunks):
            status, claims, at = state.get(chunk, ("pending", 0, 0.0))
            if (status == "pending" or status == "running" and now - at > stale_after_seconds) and self._create(f"chunk-{chunk}.claim-{claims + 1}"):
                return chunk
        return None

    def complete(self, chunk: int) -> bool:
        """Mark a chunk complete; whether this was the first time."""
        return self._create(f"chunk-{chunk}.done")

    def completed(self) -> list[int]:
        return sorted(c for c, (status, _, _) in self._state().items() if status == "complete")


def remaining(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks of a plan that are not done: resumption is an anti-join."""
    return plan.join(done.select("chunk_id"), "chunk_id", "left_anti")


def exclude_existing(df: DataFrame, existing: DataFrame | None, key: str = "basket_id") -> DataFrame:
    """Rows whose key ``existing`` (None: nothing) does not have."""
    return df if existing is None else df.join(existing.select(key), key, "left_anti")


def merge_keep_last(old: DataFrame, new: DataFrame, key: str = "basket_id") -> DataFrame:
    """Old and new rows; a key that both have keeps the new row."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_refusing_duplicates(df: DataFrame, key: str = "basket_id") -> DataFrame:
    """The rows, after a check that no key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} occurs {twice[0]['count']} times")
    return df


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert_log(log: DataFrame | None, row: DataFrame, key: str = "run", by: str = "excess") -> DataFrame:
    """The log with ``row`` in place of an earlier one of the same run; new columns are null in old rows; best first."""
    out = row if log is None else log.join(row.select(key), key, "left_anti").unionByName(row, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last(by), key) if by in out.columns else out.orderBy(key)


def content_digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): one pass over all rows, whatever their order."""
    return df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def capped_write(df: DataFrame, path: str, cap: int) -> int:
    """Write unless there are more than ``cap`` rows; returns their number."""
    n = df.limit(cap + 1).count()
    if n > cap:
        raise ValueError(f"more than {cap} rows; not written")
    df.write.mode("overwrite").parquet(path)
    return n


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder a table, with all its rows."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{valid_tag(name)}")


def export_workbook(tables: dict[str, DataFrame], path: str, cap: int = 1_000_000) -> dict[str, bool]:
    """A spreadsheet file (Office Open XML) on the driver, a sheet a table, at most ``cap`` rows of each, which is what a
    sheet holds; tells which were cut. Rows are written one by one as they come. Nested values are written as text."""
    cell = lambda v: "<c/>" if v is None else f'<c t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f"<c><v>{v!r}</v></c>" if isinstance(v, (int, float)) and v == v and abs(v) != float("inf") else f'<c t="inlineStr"><is><t xml:space="preserve">{_xml(v)}</t></is></c>'
    head, main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    parts, rel = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cut, names = {}, [valid_tag(n)[:31] for n in tables]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        each = range(1, len(names) + 1)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{parts}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet}.worksheet+xml"/>' for i in each) + "</Types>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{parts}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(each, names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{parts}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in each) + "</Relationships>")
        for i, (name, df) in enumerate(tables.items(), 1):
            cut[name] = df.limit(cap + 1).count() > cap
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData><row>{"".join(map(cell, df.columns))}</row>'.encode())
                for r in df.limit(cap).toLocalIterator():
                    f.write(f"<row>{''.join(map(cell, r))}</row>".encode())
                f.write(b"</sheetData></worksheet>")
    return cut


def _xml(v: object) -> str:
    return escape(re.sub(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", str(v))[:32_767])


def seed_log(log: DataFrame | None, rows: DataFrame, key: str = "run") -> DataFrame:
    """The log with rows of runs from before it; a run that the log has keeps its own row."""
    return rows if log is None else log.unionByName(rows.join(log.select(key), key, "left_anti"), allowMissingColumns=True)


def union_runs(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several runs as one, with the column ``run`` first."""
    out = None
    for run, df in sorted(tables.items()):
        now = df.select(F.lit(run).alias("run"), "*")
        out = now if out is None else out.unionByName(now, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs")
    return out
