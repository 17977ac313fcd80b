"""Log-structured stores for streaming sinks: a base, a bounded tail and a manifest.

Each micro-batch is appended as ``tail/batch_id=N``.  From time to time the base and
the tail are merged (by a reduction such as latest per key, a sum, or none) into a new base,
and a manifest that names it and the last batch it holds is committed with one
rename.  A reader takes the newest manifest's base and the batches after it, so what it reads
is the reduced base and at most ``every`` batches, however long the stream runs.

Crashes and replays.  A batch that runs again overwrites its own folder, or is ignored if the
manifest says that the base holds it.  A base without a manifest is never read, and is
left for the next cleaning.  Cleaning removes what the manifest before the newest no longer needs,
so a reader that began under that one still finds its files.  There is one writer, the streaming query.

``part`` (a number below ``PARTS``) is the folder that a row goes to; a reader that
needs a few parts reads no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 32


def hashed_part(*cols: str | Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


class LogStore:
    """``schema``: DDL of the rows; ``reduce``: merges rows of any number of batches (None: all rows are
    kept); ``part``: the rows' part (None: all in one); ``every``: batches between two compactions."""

    def __init__(self, spark: SparkSession, path: str, schema: str, reduce: Callable[[DataFrame], DataFrame] | None = None,
                 part: Column | None = None, every: int = 8):
        self.spark, self.path, self.schema, self.reduce, self.every = spark, path.rstrip("/"), schema, reduce, every
        self.part = F.lit(0) if part is None else part
        self.fields = T.StructType.fromDDL(schema).fields
        self.columns = [f.name for f in self.fields]
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def manifest(self, back: int = 0) -> dict:
        """The newest manifest (or the one ``back`` before it): ``version``, ``base``, ``upto``."""
        known = sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith("."))
        if len(known) <= back:
            return {"version": 0, "base": None, "upto": -1}
        lines = self.spark.read.text(f"{self.path}/manifest/{known[-1 - back]:012d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def batches(self) -> list[int]:
        """Batches of the tail that the newest base does not hold."""
        upto = self.manifest()["upto"]
        return sorted(b for b in (int(n.split("=")[1]) for n in self._names("tail") if n.startswith("batch_id=")) if b > upto)

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Write a batch; False if the base already holds it (a replay)."""
        if batch_id <= self.manifest()["upto"]:
            return False
        self._write(rows, f"tail/batch_id={batch_id}")
        return True

    def _write(self, rows: DataFrame, folder: str) -> None:
        """A few files for each part: small parts share tasks, large ones are split."""
        rows.select(*self.columns).withColumn("part", self.part).hint("rebalance", "part") \
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(f"{self.path}/{folder}")

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """Unreduced rows of the base and the tail (of batches under ``before``), of the given parts only."""
        m = self.manifest()
        tails = [b for b in self.batches() if before is None or b < before]
        folders = ([m["base"]] if m["base"] else []) + [f"tail/batch_id={b}" for b in tails]
        if not folders:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields])
        out = None
        for f in folders:
            rows = self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.path}/{f}")
            rows = (rows if parts is None else rows.where(F.col("part").isin(parts))).select(*self.columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    def current(self) -> DataFrame:
        rows = self.read()
        return rows if self.reduce is None else self.reduce(rows)

    def compact(self) -> None:
        """Merge base and tail into a new base and commit it."""
        m, tail = self.manifest(), self.batches()
        if not tail:
            return
        base = self._write_base(self.current(), m["version"] + 1)
        self._commit({"version": m["version"] + 1, "base": base, "upto": tail[-1]})
        self._clean()

    def _write_base(self, rows: DataFrame, version: int) -> str:
        base = f"base/{version:012d}-{uuid.uuid4().hex[:8]}"
        self._write(rows, base)
        return base

    def _commit(self, manifest: dict) -> None:
        final = self._path(f"{self.path}/manifest/{manifest['version']:012d}.json")
        draft = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"{final} was written by another writer")

    def _clean(self) -> None:
        now, before = self.manifest(), self.manifest(1)
        for name in self._names("tail"):
            if name.startswith("batch_id=") and int(name.split("=")[1]) <= before["upto"]:
                self._remove(f"tail/{name}")
        for name in self._names("base"):
            if f"base/{name}" not in (now["base"], before["base"]):
                self._remove(f"base/{name}")

    def appended(self, rows: DataFrame, batch_id: int) -> None:
        """``append``, and a compaction whenever the tail has ``every`` batches."""
        self.append(rows, batch_id)
        if len(self.batches()) >= self.every:
            self.compact()
