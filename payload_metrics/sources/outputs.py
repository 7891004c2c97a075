"""Output tables, and logs that streams write and read, as plain partitioned parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from payload_metrics.operators.dedupe import FINGERPRINT_SCHEMA, fold_touches, stored_ttl
from payload_metrics.operators.metrics import POINT_SCHEMA, newest_points, series_text
from payload_metrics.sources.tables import discard, folder_names, mark

#: The file by which a writer marks a folder as complete.
DONE = "_SUCCESS"


def write_part(df: DataFrame, path: str, part: str, source: str) -> None:
    """Writes what one batch or run has of one source; a repeated one replaces itself, and only
    itself: other sources in the same tables may use the same batch or run ids."""
    folder = f"{path}/{part}/{source_folder(source)}"
    df.where(F.col("source") == source).drop("source").write.mode("overwrite").parquet(folder)


def source_folder(source: str) -> str:
    """As partition folders are named: characters that paths or patterns use are escaped."""
    return "source=" + "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{}[]^" else c for c in source)


def read_parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All parts of an output table; empty when no part holds a row."""
    return spark.read.schema(schema).parquet(path)


class BatchLog:
    """What the batches of a stream add, source by source: ``source=S/batch_id=N`` for each batch,
    and ``source=S/snapshot_id=N`` for all batches up to ``N`` together.

    A batch that is run again reads what came before it and replaces its own folder. A snapshot
    counts from the moment its writer has marked it as complete. It takes the place of the batches
    it covers, whose folders then go, so a reader lists one snapshot and the batches since.
    Snapshots lie in folders by day, so that a reader can leave old days alone.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self._spark = spark
        self._path = path
        self._schema = schema

    def append(self, rows: DataFrame, batch_id: int, source: str) -> None:
        folder = f"{self._folder(source)}/batch_id={batch_id}"
        rows.where(F.col("source") == source).drop("source").write.mode("overwrite").parquet(folder)

    def parts(self, source: str | None = None, before_batch: int | None = None) -> dict[str, list[str]]:
        """Folders of the newest complete snapshot and of the batches after it, by kind."""
        found: dict[str, list[str]] = {"snapshot_id": [], "batch_id": []}
        names = [n for n in folder_names(self._spark, self._path) if n.startswith("source=")]
        for folder in names if source is None else [source_folder(source)]:
            at = f"{self._path}/{folder}"
            ids = self._ids(at, before_batch)
            complete = [i for i in ids["snapshot_id"] if DONE in folder_names(self._spark, f"{at}/snapshot_id={i}")]
            newest = max(complete, default=None)
            if newest is not None:
                found["snapshot_id"].append(f"{at}/snapshot_id={newest}")
            found["batch_id"] += [f"{at}/batch_id={i}" for i in ids["batch_id"] if newest is None or i > newest]
        return found

    def read(
        self, source: str | None = None, before_batch: int | None = None, since_day: Column | None = None
    ) -> DataFrame:
        """Rows of earlier batches with their ``batch_id``, from the snapshot with its id; of the
        snapshot only those on and after a day, if given."""
        out = None
        for kind, folders in self.parts(source, before_batch).items():
            if not folders:
                continue
            day = ", day date" if kind == "snapshot_id" else ""
            reader = self._spark.read.schema(f"{self._schema}, {kind} bigint{day}").option("basePath", self._path)
            rows = reader.parquet(*folders)
            if day:
                rows = rows if since_day is None else rows.where(F.col("day") >= since_day)
                rows = rows.drop("day").withColumnRenamed(kind, "batch_id")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self._spark.createDataFrame([], f"{self._schema}, batch_id bigint")

    def write_snapshot(self, rows: DataFrame, day: Column, within: Column, snapshot_id: int, source: str) -> None:
        """Writes one snapshot and takes away what it covers. ``rows`` may read the log itself; they
        are spread over files by day and ``within`` the day."""
        folder = self._folder(source)
        path = f"{folder}/snapshot_id={snapshot_id}"
        dated = rows.where(F.col("source") == source).drop("source", "batch_id").withColumn("day", day)
        # Ranges, so that a day of any size is spread over tasks and a task writes few days.
        dated.repartitionByRange("day", within).write.mode("overwrite").partitionBy("day").parquet(path)
        ids = self._ids(folder, snapshot_id + 1)
        for old in ids["batch_id"]:
            discard(self._spark, f"{folder}/batch_id={old}")
        for old in ids["snapshot_id"]:
            if old < snapshot_id:
                discard(self._spark, f"{folder}/snapshot_id={old}")

    def has_snapshot(self, source: str, snapshot_id: int) -> bool:
        return DONE in folder_names(self._spark, f"{self._folder(source)}/snapshot_id={snapshot_id}")

    def _ids(self, folder: str, before: int | None) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {"snapshot_id": [], "batch_id": []}
        for name in folder_names(self._spark, folder):
            kind, _, number = name.partition("=")
            if kind in found and (before is None or int(number) < before):
                found[kind].append(int(number))
        return found

    def _folder(self, source: str) -> str:
        return f"{self._path}/{source_folder(source)}"


class FingerprintLog(BatchLog):
    """Fingerprints as touches per batch.

    Each batch adds only its own touches, so no batch rewrites the store. Only misses touch, so
    within the TTL a fingerprint has one live row and probing needs no merge.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, FINGERPRINT_SCHEMA)

    def touched(
        self, before_batch: int | None = None, source: str | None = None, alive_at: int | None = None
    ) -> DataFrame:
        """Touches of earlier batches; with ``alive_at`` only those whose TTL had not ended then."""
        day = None if alive_at is None else F.to_date(F.timestamp_seconds(F.lit(alive_at)))
        rows = self.read(source, before_batch, day).drop("batch_id")
        return rows if alive_at is None else rows.where(F.col("last_seen") + stored_ttl() >= alive_at)

    def snapshot(self) -> DataFrame:
        """The log folded to one row per fingerprint, as upserting touch after touch would."""
        return fold_touches(self.touched())

    def compact(self, source: str, before_batch: int, late: int) -> None:
        """Folds all touches before a batch into a snapshot, without fingerprints whose TTL ended
        more than ``late`` seconds before the newest touch. Does nothing the second time."""
        if self.has_snapshot(source, before_batch - 1):
            return
        rows = self.touched(before_batch, source)
        newest = rows.agg(F.max("last_seen")).first()[0]
        if newest is None:
            return
        folded = fold_touches(rows).where(_expires() >= newest - late)
        self.write_snapshot(folded, _last_day(), F.col("hash"), before_batch - 1, source)

    def compacted(self, store: DataFrame, path: str, batch_id: int) -> "FingerprintLog":
        """A new log at ``path`` that starts from ``store``, such as a trimmed snapshot."""
        dated = store.withColumns({"snapshot_id": F.lit(batch_id), "day": _last_day()})
        dated.write.mode("overwrite").partitionBy("source", "snapshot_id", "day").parquet(path)
        for name in folder_names(self._spark, path):
            if name.startswith("source="):
                mark(self._spark, f"{path}/{name}/snapshot_id={batch_id}/{DONE}")
        return FingerprintLog(self._spark, path)


def _expires() -> Column:
    return F.col("last_seen") + stored_ttl()


def _last_day() -> Column:
    """The day on which a fingerprint's TTL ends."""
    return F.to_date(F.timestamp_seconds(_expires()))


class PointLog(BatchLog):
    """Metric points of windows that are still filling: every batch adds the new state of the
    windows it changed, and the newest state of a window counts."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, POINT_SCHEMA)

    def points(self, source: str | None = None) -> DataFrame:
        return newest_points(self.read(source))

    def compact(self, source: str, before_batch: int) -> None:
        """Folds all points before a batch into a snapshot. Does nothing the second time."""
        if self.has_snapshot(source, before_batch - 1):
            return
        newest = newest_points(self.read(source, before_batch))
        spread = F.xxhash64("metric", series_text(F.col("attrs")), "ts")
        self.write_snapshot(newest, F.to_date("ts"), spread, before_batch - 1, source)
