"""Tables that live on between micro-batches, as parquet folders under one list of commits.

A keyed table hashes its rows into bucket folders.  A batch writes one run of the buckets it
touches, and reads of the others only the buckets that its keys fall into.  Runs of a
bucket are merged level by level, so a bucket has a bounded number of files however many
batches came before, and a row is rewritten a bounded number of times per level.

What a batch has done becomes visible by its commit, one small file that lists the runs of all
tables: several tables change together or not at all.  A replayed batch starts from
the commit before it and writes its own folders and commit again, with the time that it first
ran at.  One writer at a time.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voltmap.session import cut, few, nothing
from voltmap.sources.files import Files

BUCKETS = 64
#: Runs of one level that are merged into one of the next.
FANOUT = 4
#: Beyond this many levels a merge rewrites the bucket whole.
LEVELS = 3
#: A batch with so many rows for each task and bucket is written where its rows are: they need not move to
#: their buckets to give files of a fair size.
FILE_ROWS = 5_000

_GONE, _RUN, _BUCKET = "_gone", "_run", "_bucket"


class Store:
    def __init__(
        self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT, levels: int = LEVELS
    ):
        self.spark, self.path, self.files = spark, path, Files(spark, path)
        self.buckets, self.fanout, self.levels = buckets, fanout, levels

    def commits(self) -> list[int]:
        names = self.files.names(f"{self.path}/_commits")
        return [int(x.removesuffix(".json")) for x in names if x.endswith(".json") and x[0] != "."]

    def state(self, number: int | None) -> dict:
        """What a commit lists; None: before any."""
        if number is None:
            return {"keyed": {}, "whole": {}}
        return json.loads(self.files.read(f"{self.path}/_commits/{number:020d}.json"))

    def batch(self, number: int | None = None) -> Batch:
        """The batch of this number, on top of the last commit below it; by default the next one."""
        done = self.commits()
        number = (done[-1] + 1 if done else 0) if number is None else number
        before = [x for x in done if x < number]
        return Batch(self, number, self.state(before[-1] if before else None))

    def last(self) -> Batch:
        """The state of the last commit, for reading."""
        done = self.commits()
        return Batch(self, done[-1] + 1 if done else 0, self.state(done[-1] if done else None))

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the last `keep` commits, and the runs that only removed ones list."""
        done = self.commits()
        kept = [self.state(x) for x in done[-keep:]]
        tables: dict[str, set[int]] = {}
        for state in kept:
            for name, table in state["keyed"].items():
                tables.setdefault(name, set()).update(run for parts in table["parts"].values() for run, _ in parts)
            for name, table in state["whole"].items():
                tables.setdefault(name, set()).update(table["runs"])
        for x in done[:-keep]:
            self.files.remove(f"{self.path}/_commits/{x:020d}.json")
            self.files.remove(f"{self.path}/_times/{x}")
        limit = 2 * done[-1] + 3 if done else 0
        for name, runs in tables.items():
            for folder in self.files.names(f"{self.path}/{name}"):
                run = int(folder.removeprefix(f"{_RUN}="))
                if run < limit and run not in runs:
                    self.files.remove(f"{self.path}/{name}/{folder}")


class Batch:
    """Reads what earlier batches left, writes one run of each table, and commits them together."""

    def __init__(self, store: Store, number: int, state: dict):
        self.store, self.number, self.before = store, number, state
        self.after = copy.deepcopy(state)
        # Runs of a batch sort behind those of earlier ones; its merged run holds all of them.
        self.run, self.merged_run = 2 * number + 1, 2 * number + 2

    @property
    def time(self) -> Column:
        """When this batch first ran; a replay gets the same time."""
        path = f"{self.store.path}/_times/{self.number}"
        if not self.store.files.exists(path):
            self.store.files.write(path, dt.datetime.now(dt.timezone.utc).isoformat(" ", "seconds"))
        return F.lit(self.store.files.read(path)).cast("timestamp")

    # --- keyed tables

    @staticmethod
    def _bucket(table: dict) -> Column:
        return F.pmod(F.xxhash64(*table["by"]), F.lit(table["buckets"])).cast("int")

    def _rows(self, name: str, schema: StructType, parts: list[tuple[str, int]]) -> DataFrame:
        """Rows of (bucket, run) pairs, newer and older versions alike."""
        root = f"{self.store.path}/{name}"
        full = StructType([*schema.fields]).add(_GONE, "boolean").add(_RUN, "long").add(_BUCKET, "integer")
        if not parts:
            return nothing(self.store.spark, full)
        paths = [f"{root}/{_RUN}={run}/{_BUCKET}={bucket}" for bucket, run in parts]
        return self.store.spark.read.schema(full).option("basePath", root).parquet(*paths)

    @staticmethod
    def _latest(rows: DataFrame, key: list[str]) -> DataFrame:
        newest = F.max(_RUN).over(Window.partitionBy(*key))
        return rows.withColumn("_newest", newest).filter(F.col("_newest") == F.col(_RUN)).drop("_newest")

    def _standing(self, rows: DataFrame, key: list[str]) -> DataFrame:
        return self._latest(rows, key).filter(f"NOT {_GONE}").drop(_GONE, _RUN, _BUCKET)

    def _parts(self, name: str, buckets: list[int] | None = None) -> list[tuple[str, int]]:
        parts = self.before["keyed"][name]["parts"]
        wanted = sorted(parts) if buckets is None else [str(b) for b in sorted(buckets) if str(b) in parts]
        return [(b, run) for b in wanted for run, _ in parts[b]]

    def _schema(self, name: str) -> StructType:
        return StructType.fromJson(self.before["keyed"][name]["schema"])

    def current(self, name: str, schema: StructType | None = None) -> DataFrame:
        """All standing rows of a keyed table, as earlier batches left it."""
        if name not in self.before["keyed"]:
            return nothing(self.store.spark, schema or StructType())
        return self._stored(name, self._parts(name))

    def _stored(self, name: str, parts: list[tuple[str, int]], wanted: DataFrame | None = None) -> DataFrame:
        """Standing rows of (bucket, run) pairs, of the keys `wanted` if given.

        Where a bucket has one run, all its rows are the newest.
        """
        table, runs = self.before["keyed"][name], Counter(b for b, _ in parts)

        def rows(pairs):
            found = self._rows(name, self._schema(name), pairs)
            return found if wanted is None else found.join(wanted, table["by"], "left_semi").select(*found.columns)

        several = [(b, run) for b, run in parts if runs[b] > 1]
        out = rows([(b, run) for b, run in parts if runs[b] == 1]).filter(f"NOT {_GONE}").drop(_GONE, _RUN, _BUCKET)
        return out.unionByName(self._standing(rows(several), table["key"])) if several else out

    def _touched_parts(self, name: str, keys: DataFrame) -> list[tuple[str, int]]:
        table = self.before["keyed"][name]
        found = keys.select(self._bucket(table).alias("b")).distinct().collect()
        return self._parts(name, [r.b for r in found])

    def touched(self, name: str, keys: DataFrame) -> DataFrame:
        """Files' rows of the buckets that `keys` (columns named as the table's `by`) fall into."""
        return self._rows(name, self._schema(name), self._touched_parts(name, keys))

    def near(self, name: str, keys: DataFrame, schema: StructType) -> DataFrame:
        """Standing rows of `keys`, and maybe more of their buckets: the caller picks its own among them."""
        if name not in self.before["keyed"]:
            return nothing(self.store.spark, schema)
        by = self.before["keyed"][name]["by"]
        wanted = F.broadcast(keys.select(*by).distinct()) if few(keys) else None
        return self._stored(name, self._touched_parts(name, keys), wanted).select(*schema.names)

    def lookup(self, name: str, keys: DataFrame, schema: StructType) -> DataFrame:
        """Standing rows whose `by` columns are among `keys`; columns of `schema`.

        The driver learns only which of the table's buckets are touched.  Few keys go to the rows;
        many meet them in a shuffle.
        """
        if name not in self.before["keyed"]:
            return nothing(self.store.spark, schema)
        wanted = cut(keys.select(*self.before["keyed"][name]["by"]).distinct())
        wanted = F.broadcast(wanted) if few(wanted) else wanted
        return self._stored(name, self._touched_parts(name, wanted), wanted).select(*schema.names)

    def put(
        self, name: str, rows: DataFrame, key: list[str], by: list[str] | None = None, gone: DataFrame | None = None,
        size: int = 0,
    ) -> DataFrame:
        """Write rows and removals; a key's rows replace all its earlier ones.  Returns what was written.

        `by` (part of the key; all of it by default) decides the bucket; key columns hold no nulls.
        `size` is about how many rows there are, where the caller knows it.
        """
        by = by or key
        schema = rows.schema
        marked = rows.withColumn(_GONE, F.lit(False))
        if gone is not None:
            marked = marked.unionByName(gone.select(*key).distinct().withColumn(_GONE, F.lit(True)), allowMissingColumns=True)
        root = f"{self.store.path}/{name}/{_RUN}={self.run}"
        new = {"key": key, "by": by, "buckets": self.store.buckets, "parts": {}}
        table = self.after["keyed"].setdefault(name, new)
        self._write(marked.withColumn(_BUCKET, self._bucket(table)), root, size)
        written = [x.partition("=")[2] for x in self.store.files.names(root) if x.startswith(f"{_BUCKET}=")]
        table["schema"] = schema.jsonValue()
        for b in written:
            table["parts"].setdefault(b, []).append([self.run, 0])
        return self._rows(name, schema, [(b, self.run) for b in written]).filter(f"NOT {_GONE}").drop(_GONE, _RUN, _BUCKET)

    def _write(self, rows: DataFrame, root: str, size: int = 0) -> None:
        tasks = int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))
        if size < tasks * self.store.buckets * FILE_ROWS:
            # One task per bucket, or several for a large one.
            rows = rows.hint("rebalance", _BUCKET)
        # Ids are hexadecimal digests, which only an entropy coder makes shorter.
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(_BUCKET).parquet(root)

    def _due(self, parts: list[list[int]]) -> tuple[list[list[int]], int]:
        """The youngest runs of a bucket that are to be merged, and the level they get."""
        merged: list[list[int]] = []
        level = 0
        while level < self.store.levels:
            own = [p for p in parts if p[1] == level]
            if len(own) + bool(merged) < self.store.fanout:
                break
            merged = own + merged
            level += 1
        return merged, min(level, self.store.levels - 1)

    def _merge(self, name: str) -> None:
        table = self.after["keyed"][name]
        due = {b: self._due(parts) for b, parts in table["parts"].items()}
        due = {b: x for b, x in due.items() if x[0]}
        if not due:
            return
        rows = self._rows(name, StructType.fromJson(table["schema"]), [(b, run) for b in due for run, _ in due[b][0]])
        latest = self._latest(rows, table["key"])
        # Where nothing older is left, removals have done their work.
        whole = [int(b) for b, (runs, _) in due.items() if len(runs) == len(table["parts"][b])]
        if whole:
            latest = latest.filter(~(F.col(_GONE) & F.col(_BUCKET).isin(whole)))
        root = f"{self.store.path}/{name}/{_RUN}={self.merged_run}"
        self._write(latest.drop(_RUN), root)
        there = set(self.store.files.names(root))
        for b, (runs, level) in due.items():
            rest = [p for p in table["parts"][b] if p not in runs]
            table["parts"][b] = rest + ([[self.merged_run, level]] if f"{_BUCKET}={b}" in there else [])

    # --- tables without a key

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; the run has the batch's number, so a replay adds nothing twice."""
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.store.path}/{name}/{_RUN}={self.run}")
        table = self.after["whole"].setdefault(name, {"runs": []})
        table["runs"] = [*[r for r in table["runs"] if r != self.run], self.run]
        table["schema"] = rows.schema.jsonValue()

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows of a table, in place of the earlier ones from the commit on."""
        self.after["whole"].pop(name, None)
        self.append(name, rows)

    def clear(self, name: str) -> None:
        """No rows of a table of either kind from the commit on."""
        if name in self.after["keyed"]:
            self.after["keyed"][name]["parts"] = {}
        if name in self.after["whole"]:
            self.after["whole"][name]["runs"] = []

    def whole(self, name: str) -> DataFrame:
        """Rows of a table without a key, as earlier batches left it."""
        table = self.before["whole"][name]
        if not table["runs"]:
            return nothing(self.store.spark, StructType.fromJson(table["schema"]))
        paths = [f"{self.store.path}/{name}/{_RUN}={run}" for run in table["runs"]]
        return self.store.spark.read.schema(StructType.fromJson(table["schema"])).parquet(*paths)

    def commit(self) -> None:
        for name in self.after["keyed"]:
            self._merge(name)
        self.store.files.write(f"{self.store.path}/_commits/{self.number:020d}.json", json.dumps(self.after))
