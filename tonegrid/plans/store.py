"""Tables that appear together (SNK1): commits by manifest, replacement by stimulus, idempotent runs.

A run writes each of its tables into a folder of its own, where nobody looks, and
then one small manifest that names the folders of all live runs. Renaming the
manifest to the next number is the commit: readers take the manifest of greatest
number and see all tables of a run or none. A run that fails leaves folders that
no manifest names (``clean`` deletes them); a run that is repeated, for instance a
micro-batch after a restart, is known by its name and changes nothing.

Of two runs that hold a stimulus the later one counts, for all tables at once:
every run has a table of its stimuli, and readers keep a row if no later run has
its stimulus. ``compact`` writes what is live as one run. Two writers that commit
at once take the number one after the other: the second one finds it taken, reads
the new manifest and adds itself to that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import KEY

_SEQ = "_run_seq"


class TableStore:
    """A folder of tables by stimulus."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        files, path = self._path(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _read(self, name: str) -> dict:
        files, path = self._path(name)
        stream = files.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> bool:
        """Write a file that did not exist; False if it exists. It appears whole, by a rename."""
        files, path = self._path(name)
        _, staged = self._path(f"_staged/{uuid.uuid4().hex}")
        out = files.create(staged, False)
        out.write(json.dumps(content).encode())
        out.close()
        files.mkdirs(path.getParent())
        done = not files.exists(path) and files.rename(staged, path)
        if not done:
            files.delete(staged, False)
        return done

    # manifests

    def manifest(self) -> dict:
        """The state of the store: its version and live runs, oldest first."""
        names = [n for n in self._names("_manifests") if n.endswith(".json")]
        return self._read(f"_manifests/{names[-1]}") if names else {"version": 0, "next": 1, "runs": [], "known": []}

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Apply ``change`` to the latest manifest until it is the next one; None: nothing to do."""
        while True:
            now = self.manifest()
            then = change(now)
            if then is None:
                return now
            then["version"] = now["version"] + 1
            if self._put(f"_manifests/{then['version']:012d}.json", then):
                return then

    # tables

    def publish(self, tables: dict[str, DataFrame], run: str, stimuli: DataFrame | None = None) -> dict:
        """Write all tables and commit them as ``run``; their stimuli (and those of ``stimuli``) are replaced.

        A run that is known already writes nothing. Returns the manifest.
        """
        now = self.manifest()
        if run in now["known"]:
            return now
        place = f"runs/{uuid.uuid4().hex}"
        entry = {"run": run, "folder": place, "tables": {}}
        keys = stimuli.select(F.col(KEY).cast("string").alias(KEY)) if stimuli is not None else None
        for kind, df in tables.items():
            seen = Observation()
            df.repartitionByRange(KEY).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder}/{place}/{kind}")
            entry["tables"][kind] = {"rows": seen.get["rows"]}
            mine = self.spark.read.parquet(f"{self.folder}/{place}/{kind}").select(F.col(KEY).cast("string").alias(KEY))
            keys = mine if keys is None else keys.unionAll(mine)
        if keys is None:
            raise ValueError("a run needs tables or stimuli")
        keys.distinct().write.parquet(f"{self.folder}/{place}/_stimuli")

        def add(state: dict) -> dict | None:
            if run in state["known"]:
                return None
            return {"next": state["next"] + 1, "runs": [*state["runs"], entry | {"seq": state["next"]}], "known": [*state["known"], run]}

        return self._commit(add)

    def kinds(self) -> list[str]:
        return sorted({k for r in self.manifest()["runs"] for k in r["tables"]})

    def read(self, kind: str) -> DataFrame:
        """A table as of now: of every stimulus the rows of the latest run that has it."""
        return self._live(kind, self.manifest())

    def _live(self, kind: str, state: dict) -> DataFrame:
        runs = [r for r in state["runs"] if kind in r["tables"]]
        if not runs:
            raise ValueError(f"no table {kind!r}")
        parts = [self.spark.read.parquet(f"{self.folder}/{r['folder']}/{kind}") for r in runs]
        if len(state["runs"]) == 1:
            return parts[0]
        whole = parts[0].withColumn(_SEQ, F.lit(runs[0]["seq"]))
        for r, part in zip(runs[1:], parts[1:], strict=True):
            whole = whole.unionByName(part.withColumn(_SEQ, F.lit(r["seq"])), allowMissingColumns=True)
        latest = self._stimuli(state).groupBy("_k").agg(F.max("_latest").alias("_latest"))
        kept = whole.join(latest, F.col(KEY).cast("string").eqNullSafe(F.col("_k")) & (F.col(_SEQ) == F.col("_latest")), "left_semi")
        return kept.drop(_SEQ)

    def _stimuli(self, state: dict) -> DataFrame:
        out = None
        for r in state["runs"]:
            mine = self.spark.read.parquet(f"{self.folder}/{r['folder']}/_stimuli").select(F.col(KEY).alias("_k"), F.lit(r["seq"]).alias("_latest"))
            out = mine if out is None else out.unionAll(mine)
        return out

    def compact(self) -> dict:
        """Write what is live as one run in place of all that were live when it began."""
        began = self.manifest()
        if len(began["runs"]) < 2:
            return began
        place, tables = f"runs/{uuid.uuid4().hex}", {}
        for kind in sorted({k for r in began["runs"] for k in r["tables"]}):
            seen = Observation()
            self._live(kind, began).repartitionByRange(KEY).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.folder}/{place}/{kind}")
            tables[kind] = {"rows": seen.get["rows"]}
        self._stimuli(began).select(F.col("_k").alias(KEY)).distinct().write.parquet(f"{self.folder}/{place}/_stimuli")
        old = [r["seq"] for r in began["runs"]]
        whole = {"run": f"compacted to {old[-1]}", "folder": place, "tables": tables, "seq": old[-1]}

        def swap(state: dict) -> dict | None:
            if [r["seq"] for r in state["runs"]][: len(old)] != old:
                return None  # another compaction was faster
            return state | {"runs": [whole, *state["runs"][len(old) :]]}

        return self._commit(swap)

    def clean(self) -> list[str]:
        """Delete folders of runs that the latest manifest does not name; no run may be writing, no reader reading older ones."""
        named = {r["folder"].split("/")[-1] for r in self.manifest()["runs"]}
        gone = [n for n in self._names("runs") if n not in named]
        for n in gone:
            files, path = self._path(f"runs/{n}")
            files.delete(path, True)
        return gone

    def sink(self, tables_of: Callable[[DataFrame], dict[str, DataFrame]], stream: str) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: every micro-batch is a run, named by the stream and the batch's number."""

        def write(batch: DataFrame, number: int) -> None:
            TableStore(batch.sparkSession, self.folder).publish(tables_of(batch), f"{stream} {number}")

        return write
