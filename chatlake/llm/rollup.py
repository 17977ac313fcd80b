"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are never
recounted.  A batch of changes - inserts, deletes, revised counts - becomes
signed deltas, one row for each key that it touches, and totals are the sum of
all committed deltas.

Commits are idempotent.  A batch's deltas go to a folder named by its id, and the
folder counts as committed once Spark's committer has put ``_SUCCESS`` there:
a batch that failed half-way is written anew by its retry, a batch that is
delivered again after its commit changes nothing.  ``compact`` folds the committed
deltas into a snapshot and adds their batch ids to a ledger, a table with a part for
each snapshot, so that reading stays cheap and late repeats are still known.  The
ledger is asked for single ids and only grows by the new ones; the driver sees the
names of the deltas since the last compaction, never all ids.

The deltas of a batch combine before the shuffle, so a source that holds a third
of the changes leaves each task as one row.

Nulls and edge cases: a null source, language or version is a key of its own; a null
count is 0; a null or unknown operation is an error that fails the batch before
it commits; equal change rows of one batch are changes each; an empty batch
commits with no deltas; totals of nothing are no rows; keys whose
documents and tokens are both 0 are left out.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """From ``op`` (insert, delete, revise), the keys, ``n_tokens`` and, for a revision,
    ``old_tokens``: signed ``n_docs`` and ``n_tokens`` by key."""
    op, new, old = F.col("op"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    bad = F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens.cast("long")).alias("n_tokens"))


class Rollup:
    """Totals kept under ``folder``, which driver and executors share.  One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _committed(self, kind: str) -> list[str]:
        """Names under deltas or snapshots that are complete."""
        fs, p = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.folder}/{kind}/{n}/_SUCCESS")[1]))

    def _snapshot(self) -> str | None:
        return next(iter(self._committed("snapshots")[::-1]), None)

    def _folded(self, snapshot: str | None, ids: list[str]) -> set[str]:
        """Those of the ids that the snapshot holds."""
        if snapshot is None or not ids:
            return set()
        ledger = self.spark.read.schema("batch string, snapshot long").parquet(f"{self.folder}/batches")
        return {r[0] for r in ledger.where((F.col("snapshot") <= int(snapshot)) & F.col("batch").isin(ids)).select("batch").distinct().collect()}

    def _open(self, snapshot: str | None) -> tuple[list[str], set[str]]:
        """Names of the committed deltas that the snapshot doesn't hold, and of those that it holds already."""
        names = self._committed("deltas")
        folded = self._folded(snapshot, [unquote(n[2:]) for n in names])
        return [n for n in names if unquote(n[2:]) not in folded], {n for n in names if unquote(n[2:]) in folded}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it had been committed before."""
        name = "b-" + quote(batch_id, safe="")
        if name in self._committed("deltas") or self._folded(self._snapshot(), [batch_id]):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")
        return True

    def totals(self) -> DataFrame:
        last = self._snapshot()
        paths = [f"{self.folder}/deltas/{n}" for n in self._open(last)[0]]
        paths += [f"{self.folder}/snapshots/{last}"] if last else []
        every = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")) \
            .where("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """A new snapshot of all that is committed; the deltas in it are deleted after it is complete.
        The ledger's new part counts once its snapshot is complete, and a retry writes it anew."""
        last = self._snapshot()
        new, gone = self._open(last)
        if new:
            name = f"{int(last or 0) + 1:012d}"
            ids = [(unquote(n[2:]),) for n in new]
            self.spark.createDataFrame(ids, "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batches/snapshot={name}")
            self.totals().write.mode("overwrite").parquet(f"{self.folder}/snapshots/{name}")
        for n in gone | set(new):
            fs, p = self._fs(f"{self.folder}/deltas/{n}")
            fs.delete(p, True)
