"""A table of immutable shards with size-tiered compaction and versioned manifests. DataFrame operations only.

Arrivals are appended as runs of small files. Runs whose sizes are within a factor of ``fanout`` form a tier; a tier of
``fanout`` runs or more is merged into one run of files of about ``target_bytes``, without a shuffle (the scan's splits
are coalesced). So each row is rewritten about once a tier, and the runs that the driver knows of number at most
``fanout`` times the logarithm of the table. A manifest lists the runs of a version; it is written beside and renamed
into place without overwriting, so readers see one version or the next, and of two writers one must start anew. Beside
the runs it holds the last sequence number of each source that numbers its appends, so an append that is repeated after a
lost driver adds nothing.

Null, empty and very long values, repeated and tied rows, and columns of any name are stored and returned as they are.
"""

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans import shared_path
from logloom.plans.shared import shuffles_freed
from logloom.sources import load

TARGET_BYTES = 128 << 20
FANOUT = 4
LEAST_BYTES = 1 << 20


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    path: str
    files: int
    bytes: int
    rows: int

    def tier(self, fanout: int) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / LEAST_BYTES, fanout)))


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target_bytes, self.fanout = target_bytes, fanout

    # -- manifests ---------------------------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        _, p, fs = self._hadoop(f"{self.path}/manifests")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> tuple[list[Run], dict[str, int]]:
        """Runs, and the last sequence number of each source."""
        version = self.version() if version is None else version
        if version == 0:
            return [], {}
        rows = self.spark.read.schema("path string, files bigint, bytes bigint, rows bigint, source string, sequence bigint").json(self._manifest(version)).collect()
        return [Run(r.path, r.files, r.bytes, r["rows"]) for r in rows if r.path is not None], {r.source: r.sequence for r in rows if r.source is not None}

    def runs(self, version: int | None = None) -> list[Run]:
        return self.manifest(version)[0]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:012d}.json"

    def commit(self, seen: int, runs: list[Run], sources: dict[str, int]) -> int:
        """Version ``seen + 1`` with ``runs`` and ``sources``; raises Conflict if it exists already."""
        name = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        jvm, tmp, fs = self._hadoop(name)
        out = fs.create(tmp, False)
        lines = [asdict(r) for r in runs] + [{"source": k, "sequence": n} for k, n in sorted(sources.items())]
        out.write(bytearray("".join(json.dumps(x) + "\n" for x in lines or [{}]), "utf-8"))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(kind, 1)
        none[0] = kind.NONE
        final = jvm.org.apache.hadoop.fs.Path(self._manifest(seen + 1))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(tmp, final, none)
        except Exception as e:
            fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(self._manifest(seen + 1)) from e
            raise
        return seen + 1

    # -- runs --------------------------------------------------------------------------------------------------------

    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _measured(self, base: str, inner: str) -> list[Run]:
        """Files, bytes and rows of each run below ``base``; ``inner`` is a pattern of what follows base in a file's path
        up to its run. Only footers are read."""
        at = F.regexp_extract(F.col("f.file_path"), inner, 1)
        stored = self._scan([base])
        files = stored.select(stored.metadataColumn("_metadata").alias("f")).groupBy(at.alias("run"), F.col("f.file_path").alias("p")).agg(F.first("f.file_size").alias("s"), F.count("*").alias("n"))
        found = files.groupBy("run").agg(F.count("*").alias("files"), F.sum("s").alias("bytes"), F.sum("n").alias("rows")).orderBy("run").collect()
        return [Run(f"{base}{r.run}", r["files"], r["bytes"], r["rows"]) for r in found]

    def append(self, arrivals: DataFrame, arrival: Column | None = None, source: str | None = None, sequence: int = 0, attempts: int = 5) -> list[Run]:
        """Writes ``arrivals`` as one run, or as one for each value of ``arrival`` in a single pass, and commits. Without
        rows nothing is committed. A ``source`` may number its appends in ascending order: one whose ``sequence`` is not
        above the last that was committed is left out, so it can be repeated when its outcome is unknown."""
        if source is not None and sequence <= self.manifest()[1].get(source, sequence - 1):
            return []
        base = f"{self.path}/runs/{uuid.uuid4().hex}"
        columns = [F.col(f"`{f.name}`") for f in self.schema.fields]
        if arrival is None:
            arrivals.select(*columns).write.parquet(base)
            new = self._measured(base, "()")
        else:
            name = "_arrival"
            while name.lower() in {f.name.lower() for f in self.schema.fields}:
                name += "_"
            arrivals.select(*columns, arrival.alias(name)).write.partitionBy(name).parquet(base)
            new = self._measured(base, rf"(/{name}=[^/]*)/[^/]*$")
        for _ in range(attempts if new else 0):
            seen = self.version()
            runs, sources = self.manifest(seen)
            if source is not None:
                if sequence <= sources.get(source, sequence - 1):
                    return []
                sources[source] = sequence
            try:
                self.commit(seen, runs + new, sources)
                return new
            except Conflict:
                continue
        if new:
            raise Conflict(f"{attempts} attempts")
        return new

    def compact(self, attempts: int = 5) -> int:
        """Merges every tier that is full, lowest first, until none is; returns the number of merges. If another writer
        commits meanwhile, its runs are kept; if it merged the same runs, the work is given up."""
        merges = 0
        while True:
            tiers: dict[int, list[Run]] = {}
            for r in self.runs():
                tiers.setdefault(r.tier(self.fanout), []).append(r)
            full = [t for t, rs in sorted(tiers.items()) if len(rs) >= self.fanout]
            if not full:
                return merges
            old = tiers[full[0]]
            size, rows = sum(r.bytes for r in old), sum(r.rows for r in old)
            n = max(1, round(size / self.target_bytes))
            base = f"{self.path}/runs/{uuid.uuid4().hex}"
            merged = self._scan([r.path for r in old]).coalesce(n).write
            merged.option("maxRecordsPerFile", max(1, math.ceil(rows / n * 1.5))).parquet(base)
            new = self._measured(base, "()")
            if sum(r.rows for r in new) != rows:
                raise RuntimeError(f"{base} has {new} of {rows} rows")
            for _ in range(attempts):
                seen = self.version()
                now, sources = self.manifest(seen)
                gone = {r.path for r in old}
                if not gone <= {r.path for r in now}:
                    break
                try:
                    self.commit(seen, [r for r in now if r.path not in gone] + new, sources)
                    break
                except Conflict:
                    continue
            merges += 1

    def vacuum(self) -> int:
        """Deletes the folders of runs that the latest manifest does not list; older versions can't be read then.
        For times without other writers."""
        keep = {r.path for r in self.runs()}
        _, p, fs = self._hadoop(f"{self.path}/runs")
        n = 0
        for s in fs.listStatus(p) if fs.exists(p) else []:
            inner = [s.getPath()] + [x.getPath() for x in fs.listStatus(s.getPath()) if x.isDirectory()]
            used = [any(k.endswith(f"/{s.getPath().getName()}" + (f"/{q.getName()}" if i else "")) for k in keep) for i, q in enumerate(inner)]
            gone = [] if used[0] else inner[:1] if not any(used) else [q for q, u in zip(inner[1:], used[1:]) if not u]
            n += sum(fs.delete(q, True) for q in gone)
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the latest). An empty table has no rows."""
        paths = [r.path for r in self.runs(version)]
        return self._scan(paths) if paths else self.spark.createDataFrame([], self.schema)


def query(spark, sf_dir, arrivals: int = 8):
    """The documents arrive in ``arrivals`` lots over two appends; what the compacted table holds is returned by row."""
    docs = load(spark, sf_dir, "documents")
    table = ShardTable(spark, shared_path(spark, "shards"), docs.schema)
    lot = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(arrivals))
    with shuffles_freed(spark):
        for k, half in enumerate((lot < arrivals // 2, lot >= arrivals // 2)):
            table.append(docs.filter(half), lot, source="documents", sequence=k + 1)
            table.compact()
    table.vacuum()
    return table.read().select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


QUERIES = {"op4_sharding": query}
ORACLES = {"op4_sharding": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"}
