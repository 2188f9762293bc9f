"""Shards in size tiers, under a versioned manifest.

Arrivals are appended as runs of small immutable Parquet files. Runs of similar size (the
same power of ``fanout``) merge, once ``fanout`` of them are there, into one run of files of
about ``target_bytes``, sorted by key. The manifest is a small JSON file per version that
lists the live runs; a version is committed by renaming its file to a name that must not
exist yet, so of two writers one fails and nothing is half visible. Readers take the
last version's runs. ``vacuum`` deletes run folders that no kept version lists.

All data work is DataFrame operations; the driver handles one entry per run, of which there
are at most ``fanout - 1`` in a tier after compaction. Merging sorts by (key, hash of the row's
text), so rows with one key may go to several files. Rows are never changed, dropped or
merged: repeats, nulls and further columns stay. Empty arrivals add no run.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm import _tables

TARGET_BYTES, FANOUT, SMALLEST = 32 << 20, 4, 64 << 10
ARRIVALS = 12


class ManifestConflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Run:
    name: str
    rows: int
    bytes: int
    files: int

    def tier(self, fanout: int) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / SMALLEST, fanout)))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "doc_id", text: str = "text", target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.text, self.target, self.fanout = key, text, target_bytes, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # -- manifest

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def runs(self, version: int | None = None) -> list[Run]:
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._path(self._file(version)))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(raw)["runs"]]

    def _file(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def _commit(self, base: int, runs: list[Run]) -> int:
        body = json.dumps({"version": base + 1, "runs": [asdict(r) for r in runs]}, sort_keys=True)
        draft = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(body.encode()))
        stream.close()
        try:
            self._context.rename(draft, self._path(self._file(base + 1)), self._none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(self._file(base + 1))):
                raise ManifestConflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    def _last(self) -> int:
        known = self.versions()
        return known[-1] if known else 0

    # -- data

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/runs/{r.name}" for r in runs])

    def _measured(self, names: list[str]) -> list[Run]:
        """Rows, bytes and files of written runs, from the files' footers."""
        out = []
        for name in names:
            path = self._path(f"{self.root}/runs/{name}")
            if not self._fs.exists(path):
                continue
            files = [s for s in self._fs.listStatus(path) if s.getPath().getName().startswith("part-")]
            rows = self.spark.read.schema(self.schema).parquet(path.toString()).count() if files else 0
            if rows:
                out.append(Run(name, rows, sum(s.getLen() for s in files), len(files)))
        return out

    def append(self, arrivals: DataFrame, batch: str | None = None, batches: int = 1) -> int:
        """One run per value of ``batch`` (a column from 0 to batches - 1, not stored), or one
        run in all, in one commit."""
        base, prefix = self._last(), f"a{uuid.uuid4().hex}"
        rows = arrivals.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema], *([F.col(batch).alias("__batch")] if batch else []))
        if batch is None:
            rows.write.parquet(f"{self.root}/runs/{prefix}")
            names = [prefix]
        else:
            rows.write.partitionBy("__batch").parquet(f"{self.root}/runs/{prefix}")
            names = [f"{prefix}/__batch={k}" for k in range(batches)]
        return self._commit(base, self.runs(base) + self._measured(names))

    def plan(self, runs: list[Run]) -> list[Run]:
        """The runs to merge next: the first ``fanout`` of the lowest tier that has as many."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(r.tier(self.fanout), []).append(r)
        return next((same[: self.fanout] for _, same in sorted(tiers.items()) if len(same) >= self.fanout), [])

    def compact(self, clean: bool = False) -> int:
        """Merge until no tier is full; each merge is one commit. The last version.

        ``clean``: after each commit merged runs and what the merge left in shuffles go, so
        the space that compaction needs is that of one merge."""
        while group := self.plan(runs := self.runs(base := self._last())):
            gone, name = {r.name for r in group}, f"m{uuid.uuid4().hex}"
            files = max(1, round(sum(r.bytes for r in group) / self.target))
            order = [F.col(self.key).asc_nulls_first(), F.xxhash64(self.text)]
            merged = self._read(group).repartitionByRange(files, *order).sortWithinPartitions(*order)
            merged.write.parquet(f"{self.root}/runs/{name}")
            self._commit(base, [r for r in runs if r.name not in gone] + self._measured([name]))
            if clean:
                del merged
                self.vacuum()
                _tables.release_shuffles(self.spark)
        return self._last()

    def vacuum(self, keep: int = 1) -> None:
        """Delete runs that none of the last ``keep`` versions lists."""
        kept = {r.name for v in self.versions()[-keep:] for r in self.runs(v)}
        parents = {name.split("/")[0] for name in kept}
        for s in self._fs.listStatus(self._path(f"{self.root}/runs")):
            name = s.getPath().getName()
            if name not in parents:
                self._fs.delete(s.getPath(), True)
            elif name not in kept:  # batches of one append
                for part in self._fs.listStatus(s.getPath()):
                    if f"{name}/{part.getPath().getName()}" not in kept:
                        self._fs.delete(part.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.runs(version))

    def located(self, version: int | None = None) -> DataFrame:
        """The rows with ``shard`` (the file below runs/) and ``shard_bytes``."""
        runs = self.runs(version)
        if not runs:
            return self._read(runs).withColumns({"shard": F.lit(None).cast("string"), "shard_bytes": F.lit(None).cast("long")})
        file = F.col("_metadata.file_path")
        rows = self._read(runs).select(*[f"`{f.name}`" for f in self.schema if f.name not in ("shard", "shard_bytes")], F.regexp_extract(file, "/runs/(.*)$", 1).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))
        return rows


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in twelve batches; what the last manifest lists, with each row's shard."""
    docs = _tables.table(spark, sf_dir, "documents")
    store = ShardStore(spark, _tables.fresh_path(spark, "shards"), docs.schema)
    store.append(docs.withColumn("__arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "__arrival", ARRIVALS)
    version = store.compact(clean=True)
    return store.located(version).withColumn("manifest_version", F.lit(version).cast("long"))
