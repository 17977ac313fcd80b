"""Best-fit packing: pattern packing by non-negative least squares.

1. Every text becomes its token ids and an end id; only longer ones than the
   capacity are cut into pieces of that length.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the
   data's size) is rounded up to length classes.  Patterns of a few
   documents whose classes fill a sequence are enumerated, and their
   repeat counts fitted to the histogram by non-negative least squares,
   then rounded and held to the documents there are.  This is done for the
   few ``GRIDS`` of class widths and depths, and the best plan is used.
3. What remains, the residual, goes by best fit, longest first, into the space
   left in the pattern sequences and into new ones.  All this is done on
   counts: the plan is a list of (lengths, repeats).
4. Pieces are numbered within their length, and the plan's intervals of such
   numbers give each its sequence and offset, by a broadcast join on the length.

The broadcast plan holds at most ``MAX_PLAN`` intervals: it has one for each place of
each distinct composition, a number that the lengths bound and not the
documents; a larger plan is joined by a shuffle instead.

Nulls and edge cases: a null or empty text is the end id alone; a null id packs
like any other; repeated rows are packed one by one; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import base, cut, rank_in_groups
from .tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: (length classes, most documents of a pattern); the one that gives the fewest sequences is used.
GRIDS = ((256, 2), (64, 3))
MAX_PLAN = 4_000_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every text."""
    ship_package(docs.sparkSession)
    d = base(docs, id_col, text_col)
    schema = T.StructType([T.StructField("_id", d.schema["_id"].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])

    def cut_texts(batches) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer_path(tokenizer)).many
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append(r), piece.append(k), start.append(at // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return d.mapInArrow(cut_texts, schema).withColumnRenamed("_id", id_col)


def patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` classes (1 to ``classes``) that sum to ``classes``, largest first."""
    def grow(left: int, most: int, places: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif places:
            for c in range(min(left, most), 0, -1):
                if c * places >= left:
                    for rest in grow(left - c, c, places - 1):
                        yield (c, *rest)

    return list(grow(classes, classes, depth))


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Least squares under x >= 0 by an active set: free the variable with the
    steepest descent, solve on the free ones, step back to the boundary where a free one
    would turn negative."""
    gram, start = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    for _ in range(4 * a.shape[0]):
        slope = start - gram @ x
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tol * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[j] = True
        while True:
            k = np.flatnonzero(free)
            s = np.zeros_like(x)
            s[k] = np.linalg.lstsq(gram[np.ix_(k, k)], start[k], rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            x = x + np.min(x[low] / np.maximum(x[low] - s[low], 1e-300)) * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def fitted_patterns(hist: dict[int, int], capacity: int, n_classes: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of classes with whole repeat counts that the histogram covers."""
    width = -(-capacity // n_classes)
    have = np.zeros(n_classes + 1, np.int64)
    for length, n in hist.items():
        have[-(-length // width)] += n
    options = [p for p in patterns(n_classes, depth) if len(p) > 1 and all(have[c] for c in p)]
    if not options:
        return []
    a = np.zeros((n_classes, len(options)))
    for j, p in enumerate(options):
        for c in p:
            a[c - 1, j] += 1
    repeats = np.rint(nnls(a, have[1:].astype(float))).astype(np.int64)
    out = []
    for j in sorted(range(len(options)), key=lambda j: (-max(options[j]), -repeats[j])):
        need = {c: options[j].count(c) for c in options[j]}
        n = min([int(repeats[j]), *(int(have[c]) // k for c, k in need.items())])
        if n > 0:
            out.append((options[j], n))
            for c, k in need.items():
                have[c] -= n * k
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY, grids=GRIDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) for all pieces of the histogram."""
    return min((_plan(hist, capacity, c, d) for c, d in grids), key=lambda p: sum(n for _, n in p))


def _plan(hist: dict[int, int], capacity: int, n_classes: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    width = -(-capacity // n_classes)
    runs: dict[int, list[list[int]]] = {}
    for length in sorted(hist, reverse=True):
        runs.setdefault(-(-length // width), []).append([length, hist[length]])

    def take(c: int, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, have = runs[c][0]
            m = min(have, n)
            out.append((length, m))
            n -= m
            runs[c][0][1] -= m
            if have == m:
                runs[c].pop(0)
        return out

    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}      # by space left
    spaces: list[int] = []                                         # keys of groups, in order

    def put(lengths: tuple[int, ...], n: int) -> None:
        left = capacity - sum(lengths)
        if left not in groups:
            groups[left] = []
            insort(spaces, left)
        groups[left].append((lengths, n))

    for classes, n in fitted_patterns(hist, capacity, n_classes, depth):
        slots = [take(c, n) for c in classes]
        while slots[0]:
            m = min(s[0][1] for s in slots)
            put(tuple(s[0][0] for s in slots), m)
            for s in slots:
                s[0] = (s[0][0], s[0][1] - m)
                if not s[0][1]:
                    s.pop(0)
    for length, n in sorted(((x, n) for r in runs.values() for x, n in r), reverse=True):
        while n:
            k = bisect_left(spaces, length)
            if k == len(spaces):
                per = capacity // length
                if n >= per:
                    put((length,) * per, n // per)
                if n % per:
                    put((length,) * (n % per), 1)
                break
            space = spaces[k]
            lengths, have = groups[space].pop()
            if not groups[space]:
                del groups[space]
                spaces.pop(k)
            m = min(have, n)
            n -= m
            put((*lengths, length), m)
            if have > m:
                put(lengths, have - m)
    return [g for s in spaces for g in groups[s]]


def intervals(packed: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place of each composition: the numbers (of pieces of that length)
    that go there, the first sequence and the offset."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for lengths, n in packed:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            rows.append((length, at, at + n, first - at, offset))
            used[length] = at + n
            offset += length
        first += n
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("_length", "_from", "_to", "_shift", "offset"), table.T))


def pack(parts: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, grids=GRIDS) -> DataFrame:
    """Pieces (as of ``pieces``) with ``sequence_id`` and ``offset``."""
    import pandas as pd

    spark = parts.sparkSession
    parts = cut(parts)
    hist = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pd.DataFrame(intervals(plan(hist, capacity, grids)))
    places = spark.createDataFrame(table, "_length long, _from long, _to long, _shift long, offset long")
    if len(table) <= MAX_PLAN:
        places = F.broadcast(places)
    by_length = ",".join(str(hist.get(k, 0)) for k in range(max(hist, default=0) + 1))      # at most capacity + 1 numbers
    of_length = F.get(F.split(F.lit(by_length), ",").cast("array<bigint>"), F.col("length").cast("int"))
    ranked = rank_in_groups(parts, ["length"], [id_col, "piece", "ids_crc32"], "_rank", of_length)
    out = ranked.join(places, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from"))
                      & (F.col("_rank") < F.col("_to")))
    return out.select(id_col, "piece", "start", "length", "ids_crc32",
                      (F.col("_rank") + F.col("_shift")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
                   capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, id_col, text_col, tokenizer, capacity), id_col, capacity)
