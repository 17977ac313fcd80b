"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits: a bit is 1 if it is set in over half of the XXH64 values
(seed 42) of the text's 4-word shingles, repeats included.  Two fingerprints
link if they differ in at most ``max_bits`` bits; the components of the links
are the groups of near copies.

The join works on distinct fingerprints, so copies cost nothing.  The trie is
dealt out by its first levels: with the 64 bits in t blocks, a linked pair
agrees in at least t - max_bits blocks whole, so for each choice of that many
blocks the bits of these blocks stand first, and only subtries below equal
first bits have to be joined.  A task takes its subtries and traverses
pairs of their nodes together, from the root: each pair of a 0 and a 1 child adds
a differing bit, and a pair with more than ``max_bits`` of them is left there.
t follows from the number of fingerprints, so that subtries stay small.  A
subtrie with more than ``subtrie`` members is cut into buckets of about that
size, joined pair by pair of buckets in tasks of their own.  A task
hands on a spanning forest of the links that it found, not the links, so
dense groups give no more edges than members.

Nulls and edge cases: null and empty texts have fingerprint 0 and link like any
other; texts of fewer words than a shingle count as one shingle; a component's
id is its smallest id that isn't null (null if there is none); repeated rows
share fingerprint and component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import base, cut
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SUBTRIE = 512


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned; of the whole text."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()          # ASCII letters and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1:]
    h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        set_bits += np.unpackbits(h[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``_id`` and ``_fp``: the fingerprint as a (signed) long."""
    ship_package(docs.sparkSession)
    d = base(docs, id_col, text_col)

    def each(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["_id", "_fp"])

    return d.mapInArrow(each, f"_id {d.schema['_id'].dataType.simpleString()}, _fp long")


def trie_pairs(values: np.ndarray, bounds: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs at most ``max_bits`` apart within each trie.

    ``values``: unsigned, sorted within [bounds[k], bounds[k + 1]), the leaves of
    trie k; a node is a range of leaves.  Pairs of nodes of all tries descend
    together, a bit at a time."""
    a0, a1 = bounds[:-1].copy(), bounds[1:].copy()
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), np.int64)
    found_i, found_j = [], []
    ones = np.zeros(len(values) + 1, np.int64)
    for depth in range(63, -1, -1):
        self_pair = a0 == b0
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        done = leaves & ~self_pair
        if done.any():
            i, j = a0[done], b0[done]
            near = np.bitwise_count(values[i] ^ values[j]) <= max_bits
            found_i.append(i[near]), found_j.append(j[near])
        go = ~leaves
        a0, a1, b0, b1, err = a0[go], a1[go], b0[go], b1[go], err[go]
        if not len(a0):
            break
        np.cumsum((values >> np.uint64(depth)) & np.uint64(1), out=ones[1:], dtype=np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1),
                 *[tuple(x[~own] for x in (am, a1, b0, bm, err + 1))]]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts))
        ok = (a1 > a0) & (b1 > b0) & (err <= max_bits)
        a0, a1, b0, b1, err = a0[ok], a1[ok], b0[ok], b1[ok], err[ok]
    else:                                       # 64 bits down: single leaves, as values are distinct
        done = a0 != b0
        found_i.append(a0[done]), found_j.append(b0[done])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one that the pairs connect it to."""
    root = np.arange(n)
    while len(i):
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        open_ = root[i] != root[j]
        i, j = root[i[open_]], root[j[open_]]
    while (root[root] != root).any():
        root = root[root]
    return root


def _forests(max_bits: int, work: int):
    """Over rows sorted by subtrie (``_job``) and value: edges of spanning forests."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        def edges(jobs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts = np.flatnonzero(np.concatenate(([True], (jobs[1:] != jobs[:-1]).any(axis=1))))
            bounds = np.append(starts, len(values))
            cost = np.cumsum(np.diff(bounds).astype(np.int64) ** 2) // work
            us, vs = [], []
            for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(cost)) + 1):
                lo, hi = bounds[at[0]], bounds[at[-1] + 1]
                own = values[lo:hi]
                root = forest(len(own), *trie_pairs(own, bounds[at[0]:at[-1] + 2] - lo, max_bits))
                linked = np.flatnonzero(root != np.arange(len(own)))
                us.append(own[root[linked]]), vs.append(own[linked])
            return np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)

        jobs, values = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        out = ["u", "v"]
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            jobs = np.concatenate([jobs, np.stack([c.astype(np.int64) for c in cols[:4]], axis=1)])
            # the sort was of signed longs; a flipped first bit keeps that order for unsigned ones and all differences
            values = np.concatenate([values, cols[4].astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)])
            last = int(np.flatnonzero(np.concatenate(([True], (jobs[1:] != jobs[:-1]).any(axis=1))))[-1])
            if last:
                u, v = edges(jobs[:last], values[:last])
                yield pa.RecordBatch.from_arrays([pa.array(u ^ np.int64(-1 << 63)), pa.array(v ^ np.int64(-1 << 63))], names=out)
                jobs, values = jobs[last:], values[last:]
        if len(values):
            u, v = edges(jobs, values)
            yield pa.RecordBatch.from_arrays([pa.array(u ^ np.int64(-1 << 63)), pa.array(v ^ np.int64(-1 << 63))], names=out)

    return run


def block_masks(n: int, max_bits: int, members: int = 64) -> list[int]:
    """For each choice of whole blocks a mask of their bits; as few blocks as
    leave subtries of about ``members`` leaves."""
    t = max_bits + 1
    while t < 16 and n > members * 2 ** (64 * (t - max_bits) // t):
        t += 1
    edges = [64 * k // t for k in range(t + 1)]
    masks = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(t)]
    assert len(masks) == t and comb(t, max_bits) == comb(t, t - max_bits)
    return [sum(c) for c in combinations(masks, t - max_bits)]


def links(fps: DataFrame, max_bits: int = MAX_BITS, subtrie: int = SUBTRIE) -> DataFrame:
    """Edges ``u``, ``v`` between distinct fingerprints (``_fp``) whose components are
    those of all links."""
    ship_package(fps.sparkSession)
    n = fps.count()
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*[F.lit(signed(m)).cast("long") for m in block_masks(n, max_bits)])
    rows = fps.select("_fp", F.posexplode(masks).alias("_choice", "_mask")) \
        .select("_fp", "_choice", F.col("_fp").bitwiseAND(F.col("_mask")).alias("_top"))
    large = rows.groupBy("_choice", "_top").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > subtrie) \
        .select(F.col("_choice").alias("_c"), F.col("_top").alias("_t"), F.ceil(F.col("_n") / subtrie).cast("int").alias("_g"))
    dealt = rows.join(large, (F.col("_choice") == F.col("_c")) & (F.col("_top") == F.col("_t")), "left")
    bucket = F.pmod(F.xxhash64("_fp"), F.col("_g")).cast("int")
    whole = F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda k: F.struct(
        F.least(bucket, k).alias("lo"), F.greatest(bucket, k).alias("hi")))
    jobs = dealt.select("_choice", "_top", F.explode(F.when(F.col("_g").isNull(), F.array(whole)).otherwise(pairs)).alias("_j"), "_fp")
    key = ["_choice", "_top", "_lo", "_hi"]
    sorted_ = (jobs.select("_choice", "_top", F.col("_j.lo").alias("_lo"), F.col("_j.hi").alias("_hi"), "_fp")
               .repartition(*key).sortWithinPartitions(*key, "_fp"))
    return sorted_.mapInArrow(_forests(max_bits, 1 << 22), "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each document: the id, ``fingerprint`` (long), ``component_id``
    (smallest id) and ``component`` (a long that names the component)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = cut(prints.groupBy("_fp").agg(F.min("_id").alias("_least")))
    groups = components(links(fps.select("_fp"), max_bits))
    label = fps.join(groups, F.col("_fp") == F.col("node"), "left") \
        .select("_fp", "_least", F.coalesce("label", "_fp").alias("_label"))
    least = label.groupBy("_label").agg(F.min("_least").alias("_component_id")).withColumnRenamed("_label", "_l")
    named = label.join(least, F.col("_label") == F.col("_l")) \
        .select(F.col("_fp").alias("_f"), "_component_id", "_label")
    return prints.join(named, F.col("_fp") == F.col("_f")).select(
        F.col("_id").alias(id_col), F.col("_fp").alias("fingerprint"), F.col("_component_id").alias("component_id"),
        F.col("_label").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id, all columns.

    The kept ids are joined to the documents on the id and the fingerprint's component;
    where several rows have that id, the one with the smallest digest of text stays."""
    digest = F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      F.struct(F.col(f"`{id_col}`").alias("id"), digest.alias("md5")).alias("_k"), F.col(f"`{text_col}`").alias("_t"))
    found = near_copies(row.select("_k", "_t"), "_k", "_t", shingle, max_bits)
    order = F.struct(F.col("_k.id").isNull().alias("null"), F.col("_k.id").alias("id"), F.col("_k.md5").alias("md5"))
    best = found.groupBy("component").agg(F.min(order).alias("b")).select(
        F.struct(F.col("b.id").alias("id"), F.col("b.md5").alias("md5")).alias("_b"))
    one = row.select("_row", "_k").dropDuplicates(["_k"])
    return one.join(best, (F.col("_k.id").eqNullSafe(F.col("_b.id"))) & (F.col("_k.md5") == F.col("_b.md5")), "left_semi").select("_row.*")
