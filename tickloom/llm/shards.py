"""Size-tiered shards: small immutable files, merged by similar size, under manifests that are committed atomically.

A store is a folder: data/ has Parquet files that never change, manifest/ has one file for each version, with the files that
the version adds (rows and bytes) and those that it removes, and every SNAPSHOT versions a file that lists all live files: a
commit writes what is new, and a reader needs a snapshot and the versions after it. A file of manifest/ is written under
another name and renamed, which fails if it is there, so that of two writers one has to read the new version and try again.
Readers of a version aren't disturbed. This needs a file system that renames atomically, as HDFS and local ones do; on an
object store without such a rename, writers have to be kept apart by other means.

Before a writer makes files it leaves a note in writing/, and takes it away after its commit. vacuum() leaves the files of
notes alone until they are older than its grace period, and a commit whose note is gone fails; so no version ever names a
file that vacuum() has taken for garbage.

Files are in tiers by size, each FAN_IN times as large as the one below. FAN_IN files of a tier are merged to one, until
files have the target size: a row is rewritten once a tier. A merge reads whole files into one task that writes one file:
there is no shuffle, and the target bounds what a task handles. A batch of merges is one Spark job.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import drop_dir, file_system

FAN_IN = 4
MERGES_A_JOB = 32
SNAPSHOT = 16
#: Seconds that a writer may take from its first file to its commit.
GRACE = 7 * 24 * 3600


class Conflict(Exception):
    """Another writer has committed the version first."""


class Store:
    """A table of immutable shards.

    Rows are kept as they are: nulls in any column, empty and long texts and repeated rows stay. An arrival without rows
    adds no file, but a version. Columns that the schema doesn't name are left behind, those that an arrival lacks are an
    error. A store without versions reads as an empty table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, target_bytes: int = 128 << 20, rows_a_shard: int = 10_000):
        self.spark, self.path, self.schema, self.target, self.rows_a_shard = spark, path.rstrip("/"), schema, target_bytes, rows_a_shard
        self.fs, self.to_path = file_system(spark, path)
        for folder in ("manifest", "writing", "data"):
            self.fs.mkdirs(self.to_path(f"{self.path}/{folder}"))

    def _numbers(self, kind: str) -> list[int]:
        names = [f.getPath().getName() for f in self.fs.listStatus(self.to_path(f"{self.path}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith(kind) and n.endswith(".json"))

    def versions(self) -> list[int]:
        return self._numbers("v")

    def _load(self, name: str) -> dict:
        stream = self.fs.open(self.to_path(f"{self.path}/manifest/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _place(self, name: str, content: dict) -> None:
        """Writes a file of manifest/ by a rename; Conflict if it is there."""
        jvm, to_path = self.spark._jvm, self.to_path
        draft, final = to_path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}"), to_path(f"{self.path}/manifest/{name}")
        out = self.fs.create(draft, False)
        out.write(json.dumps(content).encode())
        out.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, no_overwrite)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} is there already") from e
            raise

    def manifest(self, version: int | None = None) -> dict:
        """The version and its live files, or those of the last; an empty one before the first commit."""
        known = self.versions()
        version = known[-1] if version is None and known else version or 0
        if not version:
            return {"version": 0, "files": []}
        base = max((n for n in self._numbers("s") if n <= version), default=0)
        files = {f["path"]: f for f in self._load(f"s{base:08d}.json")["files"]} if base else {}
        for n in range(base + 1, version + 1):
            change = self._load(f"v{n:08d}.json")
            for path in change["remove"]:
                del files[path]
            files.update((f["path"], f) for f in change["add"])
        return {"version": version, "files": list(files.values())}

    def _snapshot(self, manifest: dict) -> None:
        try:
            self._place(f"s{manifest['version']:08d}.json", manifest)
        except Conflict:
            pass  # whoever wrote it wrote the same

    def commit(self, version: int, add: list[dict], remove: list[str], notes: list[str]) -> None:
        """Makes ``version``: the one before with these changes. Conflict if there is such a version."""
        for note in notes:
            if not self.fs.exists(self.to_path(f"{self.path}/writing/{note}")):
                raise RuntimeError(f"the files of {note} are older than a vacuum's grace period")
        self._place(f"v{version:08d}.json", {"version": version, "add": add, "remove": remove})
        for note in notes:
            self.fs.delete(self.to_path(f"{self.path}/writing/{note}"), False)
        if version % SNAPSHOT == 0:
            self._snapshot(self.manifest(version))

    def _write(self, rows: DataFrame, **options: object) -> tuple[list[dict], str]:
        """Writes rows as new files and describes them, with the note of them; files without rows are left out."""
        note = uuid.uuid4().hex
        self.fs.create(self.to_path(f"{self.path}/writing/{note}"), False).close()
        folder = f"{self.path}/data/{note}"
        rows.write.options(**options).parquet(folder)
        counts = {r["f"].rsplit("/", 1)[-1]: r["n"] for r in self.spark.read.schema(self.schema).parquet(folder).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
        files = [f for f in self.fs.listStatus(self.to_path(folder)) if f.getPath().getName() in counts]
        return [{"path": f"{folder}/{f.getPath().getName()}", "rows": counts[f.getPath().getName()], "bytes": f.getLen()} for f in files], note

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as small shards; returns the new version."""
        new, note = self._write(rows.select(*self.schema.names), maxRecordsPerFile=self.rows_a_shard)
        while True:
            version = max(self.versions(), default=0) + 1
            try:
                self.commit(version, new, [], [note])
                return version
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        """Tiers from the target down: files of tier 0 have the target size, of tier -1 a FAN_IN-th of it, and so on."""
        return min(0, round(math.log(max(size, 1) / self.target, FAN_IN)))

    def groups(self, files: list[dict]) -> list[list[dict]]:
        """Files to merge: FAN_IN of a tier below 0, in order of size."""
        tiers: dict[int, list[dict]] = {}
        for f in sorted(files, key=lambda f: (f["bytes"], f["path"])):
            tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        return [run[i : i + FAN_IN] for t, run in sorted(tiers.items()) if t < 0 for i in range(0, len(run) - FAN_IN + 1, FAN_IN)]

    def compact(self) -> int:
        """Merges until no tier below the target has FAN_IN files; each round is a version. Returns the last version."""
        while groups := self.groups((now := self.manifest())["files"]):
            new, notes = [], []
            for at in range(0, len(groups), MERGES_A_JOB):
                merges = [self.spark.read.schema(self.schema).parquet(*(f["path"] for f in g)).coalesce(1) for g in groups[at : at + MERGES_A_JOB]]
                files, note = self._write(reduce(DataFrame.unionAll, merges))
                new, notes = new + files, [*notes, note]
            gone = {f["path"] for g in groups for f in g}
            if sum(f["rows"] for f in new) != sum(f["rows"] for g in groups for f in g):
                raise RuntimeError("a merge lost rows")
            while True:
                now = self.manifest()
                if not gone <= {f["path"] for f in now["files"]}:
                    raise Conflict("another compaction has merged these files")
                try:
                    self.commit(now["version"] + 1, new, sorted(gone), notes)
                    break
                except Conflict:
                    continue
        return now["version"]

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Deletes the manifests before the last ``keep`` versions, and the files that none of those left names.

        Files of a write in progress stay, unless it began more than ``grace`` seconds ago.
        """
        # in this order: a folder seen here has a note by now, or has been committed before the versions are read
        folders = [f.getPath() for f in self.fs.listStatus(self.to_path(f"{self.path}/data"))]
        now, notes = time.time(), {f.getPath().getName(): f.getModificationTime() / 1000 for f in self.fs.listStatus(self.to_path(f"{self.path}/writing"))}
        kept = self.versions()[-keep:]
        live: dict[str, set[str]] = {}
        for version in kept:
            for f in self.manifest(version)["files"]:
                folder, name = f["path"].rsplit("/", 2)[1:]
                live.setdefault(folder, set()).add(name)
        for folder in folders:
            name = folder.getName()
            if name in notes:
                if now - notes[name] <= grace:
                    continue
                self.fs.delete(self.to_path(f"{self.path}/writing/{name}"), False)
            if name not in live:
                drop_dir(self.spark, f"{self.path}/data/{name}")
                continue
            for f in self.fs.listStatus(folder):
                if f.getPath().getName().startswith("part-") and f.getPath().getName() not in live[name]:
                    self.fs.delete(f.getPath(), False)
        if kept:
            self._snapshot(self.manifest(kept[0]))
            for kind in "vs":
                for n in self._numbers(kind):
                    if n < kept[0]:
                        self.fs.delete(self.to_path(f"{self.path}/manifest/{kind}{n:08d}.json"), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or the last."""
        files = self.manifest(version)["files"]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f["path"] for f in files))
