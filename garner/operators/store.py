"""Stored tables of the engine: full replacement, merges, text index and aliases, each published at once.

A store is a folder; a table in it is a series of versions, each written whole below its own number,
and a manifest that names the one in force. A version becomes visible when its manifest is written,
so readers never see half of one, and a writer that dies leaves the last version in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.operators.aliases import build
from garner.operators.fulltext import postings
from garner.operators.ingest import fingerprint, snapshot_changes

#: Versions kept behind the one in force, for readers that began before it.
KEEP = 2


class Store:
    """Tables below one folder, which all machines share. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self, name: str) -> int:
        """Number of the version in force, 0 if there is none."""
        fs, p = self._fs(f"{self.folder}/{name}/manifest")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0)

    def read(self, name: str) -> DataFrame | None:
        """The table's version in force, or None."""
        number = self.version(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/data/{number}") if number else None

    def replace(self, name: str, rows: DataFrame, sort: str | None = None) -> int:
        """Write ``rows`` as the table's next version and put it in force; ``sort``: a column to range-sort by, so that look-ups skip files."""
        number = self.version(name) + 1
        shaped = rows if sort is None else rows.repartitionByRange(sort).sortWithinPartitions(sort)
        shaped.write.mode("overwrite").parquet(f"{self.folder}/{name}/data/{number}")
        fs, p = self._fs(f"{self.folder}/{name}/manifest/{number}")
        fs.create(p, True).close()
        for old in range(max(1, number - KEEP - 4), number - KEEP):
            for part in ("manifest", "data"):
                gone_fs, gone = self._fs(f"{self.folder}/{name}/{part}/{old}")
                gone_fs.delete(gone, True)
        return number

    def apply_snapshot(self, name: str, snapshot: DataFrame, key: str, seen: str) -> DataFrame:
        """Merge a complete snapshot, one row per key, taken at ``seen`` (text of an instant); returns its changes, counted by kind.

        Rows the snapshot lacks stay with ``deleted_at`` set, rows that come back lose it, and rows
        that are as they were keep their ``changed_at``. An empty snapshot deletes everything.
        """
        columns = [c for c in snapshot.columns if c != key]
        now = F.lit(seen).cast("timestamp")
        stored = self.read(name)
        if stored is None:
            stored = snapshot.where("false").withColumns({"changed_at": now, "deleted_at": now})
        live = stored.where("deleted_at is null")
        changes = snapshot_changes(live, snapshot, key, columns)
        mark = lambda df: fingerprint(*[F.col(c) for c in columns])
        old = stored.select(F.col(key).alias("__k"), mark(stored).alias("__old"), F.col("changed_at").alias("__at"), F.col("deleted_at").alias("__gone"))
        met = snapshot.withColumn("__new", mark(snapshot)).join(old, F.col(key) == F.col("__k"), "left")
        same = F.col("__old").eqNullSafe(F.col("__new")) & F.col("__gone").isNull()
        present = met.select(key, *columns, F.when(same, F.col("__at")).otherwise(now).alias("changed_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
        absent = stored.join(snapshot.select(key), key, "left_anti").select(key, *columns, "changed_at", F.coalesce("deleted_at", now).alias("deleted_at"))
        counted = changes.groupBy("change").agg(F.count("*").alias("n")).toPandas()  # at most four rows
        self.replace(name, present.unionByName(absent), key)
        return self.spark.createDataFrame([(r.change, int(r.n)) for r in counted.itertuples()], "change string, n long")

    def index_texts(self, name: str, rows: DataFrame, key: str, text: str) -> int:
        """Write the word index of ``rows``, sorted by word, so that a word's look-up reads few files."""
        return self.replace(f"{name}_words", postings(rows, key, text), "word")

    def index_lag(self, name: str, rows: DataFrame, key: str, text: str) -> int:
        """Records with words of which the stored index knows nothing."""
        held = self.read(f"{name}_words")
        wanted = postings(rows, key, text).select(key).distinct()
        return wanted.count() if held is None else wanted.join(held.select(key).distinct(), key, "left_anti").count()

    def update_aliases(self, refs: DataFrame, ref: str) -> int:
        """Aliases of new references beside those given before, which are reserved and stay as they are.

        A new reference's alias is longer than what its digest has in common with that of any
        reference, old or new, so it equals no reserved one.
        """
        held = self.read("aliases")
        wanted = refs.select(F.col(ref).alias("full_ref")).distinct()
        if held is None:
            return self.replace("aliases", build(wanted, "full_ref"), "alias")
        every = wanted.unionByName(held.select("full_ref")).distinct()
        fresh = build(every, "full_ref").join(held.select("full_ref"), "full_ref", "left_anti")
        return self.replace("aliases", held.select("full_ref", "alias").unionByName(fresh), "alias")

    def references(self, alias: str) -> list[str]:
        """The reference whose alias this is, else up to two of those whose aliases begin so; the aliases are sorted, so few files are read."""
        held = self.read("aliases")
        if held is None:
            return []
        found = {r["alias"]: r["full_ref"] for r in held.where(F.col("alias") == alias).collect()}
        if alias in found:
            return [found[alias]]
        return [r["full_ref"] for r in held.where(F.col("alias").startswith(alias)).limit(2).collect()]
