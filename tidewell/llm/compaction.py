"""Sharding by size-tiered compaction, with DataFrame writes only.

Arrivals are appended as small immutable Parquet shards. Shards whose sizes lie in one tier (a factor of
``fanout`` wide) form a run; once a run has ``fanout`` shards, it is rewritten into files of about the target
size, without a shuffle; runs of several tiers are rewritten at once. What a version of the dataset holds is told
by its manifest, a JSON file that is written aside and renamed to its version's name without overwriting; readers
see the old version or the new one whole. A manifest lists what was added and removed since the version before;
every WHOLE-th one lists all. Replaced files go once no kept version names them.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
FANOUT = 4
LEAST_BYTES = 1 << 20  # shards up to this size are of tier 0
WHOLE = 16


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class ShardStore:
    """A versioned dataset below ``folder``, with one writer at a time and any number of readers.

    Rows are kept as they are: nulls in any column, repeated rows, texts of any length. Arrivals are read by the
    names of ``schema``; their other columns are dropped. An arrival without rows adds none, and a store without
    arrivals reads as an empty table.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, target: int = TARGET_BYTES, fanout: int = FANOUT, keep_versions: int = 1):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.target, self.fanout, self.keep_versions = target, fanout, keep_versions
        self.arrived = 0  # files of the arrivals that this writer appended
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files_at = self.hadoop.FileContext.getFileContext(self.hadoop.Path(self.folder).toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join([self.folder, *parts]))

    def versions(self) -> list[int]:
        at = self._path("manifest")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        stream = self.fs.open(self._path("manifest", f"v{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def base(self, version: int) -> int:
        """The last version up to this one whose manifest lists all shards."""
        return version - (version - 1) % WHOLE

    def shards(self, version: int | None = None) -> list[Shard]:
        known = self.versions()
        if not known:
            return []
        version = known[-1] if version is None else version
        held: dict[str, Shard] = {}
        for v in range(self.base(version), version + 1):
            told = self.manifest(v)
            for path in told["removed"]:
                del held[path]
            held |= {s["path"]: Shard(**s) for s in told["added"]}
        return list(held.values())

    def commit(self, added: list[Shard], removed: list[Shard] = ()) -> int:
        """Makes the next version from the last; raises if another writer made it first.

        The rename doesn't overwrite. On file systems whose rename is atomic (HDFS and its like) that is a
        compare-and-set; others need the one writer that the class asks for.
        """
        last = (self.versions() or [0])[-1]
        version = last + 1
        if self.base(version) == version:
            gone = {s.path for s in removed}
            added, removed = [s for s in self.shards() if s.path not in gone] + list(added), []
        aside, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"v{version:010d}.json")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "added": [asdict(s) for s in added], "removed": [s.path for s in removed]}).encode()))
        finally:
            stream.close()
        try:
            self.files_at.rename(aside, final, self.spark.sparkContext._gateway.new_array(self.hadoop.Options.Rename, 0))
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer") from e
        return version

    def files(self, *parts: str) -> list[Shard]:
        """The Parquet files of a finished write."""
        found = []
        for s in self.fs.listStatus(self._path(*parts)):
            if s.getPath().getName().endswith(".parquet"):
                found.append(Shard(s.getPath().toString(), s.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, df: DataFrame) -> int:
        """Writes one arrival and commits it."""
        run = f"data/{uuid.uuid4().hex}"
        self._ordered(df).write.parquet(f"{self.folder}/{run}")
        files = self.files(run)
        self.arrived += len(files)
        return self.commit(files)

    def append_each(self, df: DataFrame, arrival: str, compact: bool = True) -> list[int]:
        """Writes the arrivals of a column in one pass and commits them one by one in order, compacting after each.

        The column is not kept, unless the schema has it. Rows where it is null are the last arrival.
        """
        run = f"data/{uuid.uuid4().hex}"
        name = "arrival_" + uuid.uuid4().hex  # clashes with no column
        df.select(F.col(arrival).alias(name), *[F.col(f.name) for f in self.schema.fields]).write.partitionBy(name).parquet(f"{self.folder}/{run}")
        parts = [s.getPath().getName() for s in self.fs.listStatus(self._path(run)) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
        value = lambda n: n[len(name) + 1 :]
        order = sorted(parts, key=lambda n: (not value(n).lstrip("-").isdigit(), int(value(n)) if value(n).lstrip("-").isdigit() else 0, n))
        done = []
        for part in order:
            files = self.files(run, part)
            self.arrived += len(files)
            done.append(self.commit(files))
            if compact:
                self.compact()
        return done

    def _ordered(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name) for f in self.schema.fields])

    def tier(self, size: int) -> int:
        return 0 if size <= LEAST_BYTES else 1 + int(math.log(size / LEAST_BYTES, self.fanout))

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs that are to be merged, the lowest first: tiers with ``fanout`` or more unfinished shards."""
        runs: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target * 3 // 4:
                runs.setdefault(self.tier(s.size), []).append(s)
        return [run for _, run in sorted(runs.items()) if len(run) >= self.fanout and math.ceil(sum(s.size for s in run) / self.target) < len(run)]

    def merge(self, run: list[Shard]) -> list[Shard]:
        """Rewrites a run; the new files are not committed yet."""
        folder = f"data/{uuid.uuid4().hex}"
        self.read_shards(run).coalesce(math.ceil(sum(s.size for s in run) / self.target)).write.parquet(f"{self.folder}/{folder}")
        return self.files(folder)

    def compact(self) -> int:
        """Merges runs until none is due, those of several tiers at once; returns the number of merges. Each is a version of its own."""
        merges = 0
        while runs := self.due(self.shards()):
            with ThreadPoolExecutor(len(runs)) as pool:
                for run, made in zip(runs, pool.map(self.merge, runs), strict=True):
                    self.commit(made, run)
                    merges += 1
            self.vacuum({s.path for run in runs for s in run})
        return merges

    def vacuum(self, candidates: set[str]) -> None:
        """Deletes versions that no kept one builds on, and those of the files that no kept version names."""
        known = self.versions()
        kept = known[-self.keep_versions :]
        for v in known:
            if kept and v < self.base(kept[0]):
                self.fs.delete(self._path("manifest", f"v{v:010d}.json"), False)
        named = {s.path for v in kept for s in self.shards(v)}
        for path in candidates - named:
            self.fs.delete(self.hadoop.Path(path), False)

    def read_shards(self, shards: list[Shard]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        return self.read_shards(self.shards(version))


ARRIVALS = 8


def op6_compaction(spark, sf_dir: str) -> DataFrame:
    """``documents``, arrived in ARRIVALS parts, as the compacted store gives them back, and what the store did.

    The last columns are alike in all rows: the commits of arrivals, whether shards were merged (fewer files are
    live than arrived), and how many shards still wait in a run that is due.
    """
    from .common import shared_dir, table

    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_dir(spark, "shards"), docs.schema)
    done = store.append_each(docs.withColumn("__batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS))), "__batch")
    live = store.shards()
    told = {"n_arrivals": F.lit(len(done)).cast("long"), "merged": F.lit(len(live) < store.arrived), "n_due": F.lit(sum(map(len, store.due(live)))).cast("long")}
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).withColumns(told)


OP6_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256,
       CAST(8 AS BIGINT) AS n_arrivals, true AS merged, CAST(0 AS BIGINT) AS n_due
FROM documents
"""
