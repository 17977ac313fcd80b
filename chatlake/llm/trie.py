"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations.  A conversation is rebuilt from the first turns of its group's base
conversation and its own later ones.  A node of the trie is a distinct sequence of first turns;
a conversation is a member of every node on its path.

Nodes.  A turn is known by its MD5 and place; a sequence by the exclusive or of two 64-bit
hashes of these over its turns.  Exclusive or is associative, so sequences of any length are hashed
in parts (``PART`` turns) and no task needs a whole conversation.  Nodes, their least member, their
members and the weight of their subtree (of turns of members, a sum over members) come from one aggregation.

Rollup.  Subtree totals are sums over the descendants of a node.  Without the root, which holds
everything, the parent edges form a forest.  Each component (a connected part, named by its topmost node) is split
at its centroid, the deepest node whose subtree has half of the component's weight: the total of the
centroid's subtree is added to every node on the path from the centroid to the top, and the centroid is taken out.  What
remains falls apart into the trees below it and the tree above it, none with more than half of
the weight, so the rounds grow with the logarithm of the turns, however deep the trie.  A pair of ancestor and
descendant is counted in the one round whose centroid lies between them.

Distribution: components of at most ``LOCAL`` nodes go through all rounds inside a task; larger ones
through rounds of joins until they are as small.  A round knows the descendants of a centroid by the
least members of nodes, and paths by the turns of one member.

The hash of a node's ends is over an ordered list, so it runs through it in one task; the list
comes in strings of up to ``PART`` ids, joined beforehand in many tasks, and is never held.

Nulls and edge cases: rows without a conversation's id belong to none and are left out; a null turn
comes first; null role or text is empty; rows of one conversation and turn stand in the order of their
digests, repeated rows are turns of their own; a base that does not exist lends no turns; a
conversation left without turns ends at the root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import cut, shared_folder

#: Conversations of a group share the first turns of its first one; so many (less one) at most.
GROUP, HEADS = 100, 6
#: Turns whose hashes are combined in one task, ids in one string.
PART = 1 << 16
#: Nodes of a component that a task takes whole.
LOCAL = 4096
#: Nodes that a task rolls up together (and one component more).
AT_ONCE = 200_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(turns: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows with ``i``, the row's number from 1 within its ``c``.

    Rows are dealt into ranges of (c, order).  A row's number is that of its place within its conversation's rows of
    the range after those of the ranges before, so a conversation of any size is spread over tasks."""
    n = parts or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(turns.repartitionByRange(n, "c", *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("c").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("c", "_range").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("c").alias("_c"), F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("c", "_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(starts, (F.col("c") == F.col("_c")) & (F.col("_range") == F.col("_r"))) \
        .withColumn("i", (F.col("_start") + F.col("_place")).cast("long")).drop("_range", "_place", "_c", "_r", "_start")


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (``c``, ``p`` from 1, ``key``, ``chars``) and all conversations (``c``, ``len``)."""
    role, text = (F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in (role_col, text_col))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("_turn"), key.alias("key"),
                                 F.length(text).cast("long").alias("chars")).where("c IS NOT NULL")
    turns = cut(numbered(turns, [F.col("_turn").asc_nulls_first(), F.col("key")]).select("c", "i", "key", "chars"))
    h = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(heads))
    sizes = turns.groupBy("c").agg(F.max("i").alias("own")).withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % group)
    bases = sizes.select(F.col("c").alias("b"), F.col("own").alias("has"))
    convs = sizes.join(bases, F.col("base") == F.col("b"), "left").withColumn("lent", F.least("h", F.coalesce("has", F.lit(0))))
    convs = cut(convs.withColumn("len", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("c", "base", "h", "lent", "len"))
    first = turns.where(F.col("i") < heads).select(F.col("c").alias("b"), F.col("i").alias("p"), "key", "chars")
    lent = convs.join(first, (F.col("base") == F.col("b")) & (F.col("p") <= F.col("h"))).select("c", "p", "key", "chars")
    shift = convs.select(F.col("c").alias("k"), "h", "lent")
    own = turns.join(shift, (F.col("c") == F.col("k")) & (F.col("i") > F.col("h"))) \
        .select("c", (F.col("i") - F.col("h") + F.col("lent")).alias("p"), "key", "chars")
    return lent.unionByName(own), convs.select("c", "len")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each conversation and node on its path: ``c``, ``p`` (depth), node (``a``, ``b``), its parent
    (``pa``, ``pb``; zeros: the root), ``chars`` and ``len``."""
    t = turns.select("c", "p", "chars", F.floor((F.col("p") - 1) / PART).alias("part"), F.xxhash64("key", "p").alias("x"),
                     F.xxhash64(F.lit("second"), "p", "key").alias("y"))
    t = t.join(convs.select(F.col("c").alias("k"), "len"), F.col("c") == F.col("k")).drop("k")
    upto = Window.partitionBy("c", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"a": F.bit_xor("x").over(upto), "b": F.bit_xor("y").over(upto)})
    # only conversations longer than a part have anything to carry
    long = turns.join(convs.where(F.col("len") > PART).select(F.col("c").alias("k")), F.col("c") == F.col("k"), "left_semi")
    parts = long.groupBy("c", F.floor((F.col("p") - 1) / PART).alias("part")).agg(
        F.bit_xor(F.xxhash64("key", "p")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "p", "key")).alias("y"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(F.col("c").alias("k"), F.col("part").alias("q"), F.bit_xor("x").over(before).alias("cx"), F.bit_xor("y").over(before).alias("cy"))
    t = t.join(carry, (F.col("c") == F.col("k")) & (F.col("part") == F.col("q")), "left")
    a, b = (F.col(n).bitwiseXOR(F.coalesce(F.col(m), F.lit(0))) for n, m in (("a", "cx"), ("b", "cy")))
    return t.select("c", "p", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"), "chars", "len")


def trie_nodes(path: DataFrame) -> DataFrame:
    """Nodes but the root: ``a``, ``b``, ``pa``, ``pb``, ``depth``, ``rep`` (least member), ``n`` (members), ``weight`` (of
    the subtree), ``chars``, ``kids``."""
    n = path.groupBy("a", "b").agg(
        F.max("p").alias("depth"), F.min("c").alias("rep"), F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - F.col("p") + 1).alias("weight"),
        F.max("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    n = _written(n, "trie-nodes")
    kids = n.where("depth > 1").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("kids"))
    return n.join(kids, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left") \
        .withColumn("kids", F.coalesce("kids", F.lit(0))).drop("ka", "kb")


def split_locally(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (nodes x columns) over subtrees of a forest, by centroid decomposition.

    ``parent``: places, -1 for tops; nodes stand in order of depth within the whole.
    ``weight``: of each node's subtree.  All components go through a round together."""
    n = len(parent)
    out = np.zeros_like(values)
    weight = weight.copy()
    at = np.arange(n)
    comp = np.full(n, -1)                                          # the component's topmost node
    slices = np.split(at, np.flatnonzero(np.diff(depth)) + 1) if n else []
    for s in slices:
        comp[s] = np.where(parent[s] < 0, s, comp[parent[s]])
    live = at
    while len(live):
        tops = comp[live]
        heavy = live[2 * weight[live] >= weight[tops]]
        order = np.lexsort((heavy, depth[heavy], comp[heavy]))
        last = np.append(comp[heavy[order]][1:] != comp[heavy[order]][:-1], True)
        centroid = heavy[order][last]                              # one for each component, in order of the components' tops
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        # new components, from the top down: below a centroid its child's own, else the parent's, else the old one
        new, below = comp.copy(), np.zeros(n, bool)
        for s in slices:
            s = s[comp[s] >= 0]
            p = parent[s]
            inner = (p >= 0) & (comp[p] == comp[s])
            under = inner & (is_centroid[p] | below[p])
            below[s] = under
            new[s] = np.where(inner & is_centroid[p], s, np.where(under, new[p], comp[s]))
        inside = live[below[live] | is_centroid[live]]
        which = np.searchsorted(comp[centroid], comp[inside])
        total = np.zeros((len(centroid), values.shape[1]), values.dtype)
        np.add.at(total, which, values[inside])
        walk, k = centroid, np.arange(len(centroid))
        while len(walk):                                           # centroid-to-top paths
            out[walk] += total[k]
            up = parent[walk]
            go = (up >= 0) & (comp[up] == comp[walk])
            walk, k = up[go], k[go]
            weight[walk] -= weight[centroid[k]]
        new[centroid] = -1
        comp = new
        live = live[~is_centroid[live]]
    return out


VALUES = ("leaves", "saved")
NODE = ["a", "b", "pa", "pb", "depth", "rep", "weight", "leaf", "own", "leaves", "saved", "ta", "tb"]


def _local(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``, ``leaves``, ``saved`` of nodes whose components are small: whole components to a task."""
    rows = nodes.select(NODE).repartition("ta", "tb").sortWithinPartitions("ta", "tb", "depth")

    def each(batches) -> Iterator:
        import pyarrow as pa

        def done(t: pa.Table):
            c = {k: t[k].to_numpy() for k in NODE}
            order = np.argsort(c["depth"], kind="stable")
            c = {k: v[order] for k, v in c.items()}
            key = np.rec.fromarrays([c["a"], c["b"]])
            sort = np.argsort(key)
            up = np.rec.fromarrays([c["pa"], c["pb"]])
            found = np.minimum(np.searchsorted(key[sort], up), len(key) - 1)
            parent = np.where(key[sort][found] == up, sort[found], -1)
            parent = np.where((c["ta"][parent] == c["ta"]) & (c["tb"][parent] == c["tb"]), parent, -1)
            got = split_locally(parent, c["depth"], c["weight"], np.stack([c["leaf"], c["own"]], axis=1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["a"], c["b"], c["leaves"] + got[:, 0], c["saved"] + got[:, 1])],
                                              names=["a", "b", *VALUES])

        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows >= AT_ONCE:
                ta, tb = held["ta"].to_numpy(), held["tb"].to_numpy()
                whole = int(np.flatnonzero((ta != ta[-1]) | (tb != tb[-1]))[-1:].sum()) + 1 if (ta[0], tb[0]) != (ta[-1], tb[-1]) else 0
                if whole:
                    yield done(held.slice(0, whole))
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield done(held)

    return rows.mapInArrow(each, "a long, b long, leaves long, saved long")


def rolled_up(nodes: DataFrame, path: DataFrame, local: int | None = None) -> DataFrame:
    """``a``, ``b`` and totals over each node's subtree: ``leaves``, ``saved``.

    A round for the components of more than ``local`` nodes; see the module's text."""
    local = local or LOCAL
    zero = F.lit(0).cast("long")
    now = nodes.select("a", "b", "pa", "pb", "depth", "rep", "weight", (F.col("kids") == 0).cast("long").alias("leaf"),
                       ((F.col("n") - 1) * F.col("chars")).alias("own"), zero.alias("leaves"), zero.alias("saved"))
    heads = path.where("p = 1").select(F.col("c").alias("hc"), F.col("a").alias("ta"), F.col("b").alias("tb"))
    now = _written(now.join(heads, F.col("rep") == F.col("hc")).select(NODE), "trie-components")
    done = None
    while True:
        comps = now.groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("nodes"), F.max("weight").alias("all")).where(F.col("nodes") > local)
        comps = cut(comps.select(F.col("ta").alias("xa"), F.col("tb").alias("xb"), "all"))
        same = (F.col("ta") == F.col("xa")) & (F.col("tb") == F.col("xb"))
        if comps.isEmpty():
            small = _local(now)
            return small if done is None else small.unionByName(done)
        small = _local(now.join(comps, same, "left_anti"))
        large = now.join(comps, same).drop("xa", "xb")
        best = F.max_by(F.struct(F.col("a").alias("za"), F.col("b").alias("zb"), F.col("depth").alias("zd"), F.col("rep").alias("zr"),
                                 F.col("weight").alias("zw")), F.struct("depth", "a", "b"))
        cents = cut(large.where(2 * F.col("weight") >= F.col("all")).groupBy(F.col("ta").alias("xa"), F.col("tb").alias("xb")).agg(best.alias("z"))
                    .select("xa", "xb", "z.*"))
        # members that go on below a centroid, and by which child
        below = path.join(cents, (F.col("pa") == F.col("za")) & (F.col("pb") == F.col("zb"))) \
            .select(F.col("c").alias("mc"), F.col("a").alias("na"), F.col("b").alias("nb"), "xa", "xb", "zd")
        at = large.join(below, same & (F.col("rep") == F.col("mc")) & (F.col("depth") > F.col("zd")), "left").drop("mc", "zd", "xa", "xb")
        at = at.join(cents.select("xa", "xb", "za", "zb"), same, "left").drop("xa", "xb")
        at = _written(at.withColumn("taken", (F.col("a") == F.col("za")) & (F.col("b") == F.col("zb"))).drop("za", "zb", "all"), "trie-round")
        total = at.where("taken OR na IS NOT NULL").groupBy(F.col("ta").alias("xa"), F.col("tb").alias("xb")).agg(
            F.sum("leaf").alias("s_leaf"), F.sum("own").alias("s_own"))
        # the path of the centroid's least member down to the centroid
        goes = path.join(cents.withColumnRenamed("xa", "ya").withColumnRenamed("xb", "yb"), (F.col("c") == F.col("zr")) & (F.col("p") <= F.col("zd"))) \
            .select("ya", "yb", F.col("a").alias("ga"), F.col("b").alias("gb"), "zw")
        goes = goes.join(total, (F.col("ya") == F.col("xa")) & (F.col("yb") == F.col("xb"))).drop("xa", "xb")
        on = (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb")) & (F.col("ta") == F.col("ya")) & (F.col("tb") == F.col("yb"))
        add = lambda c, s: F.col(c) + F.coalesce(F.col(s), F.lit(0))
        moved = at.join(goes, on, "left").withColumns({
            "leaves": add("leaves", "s_leaf"), "saved": add("saved", "s_own"),
            "weight": F.col("weight") - F.when(F.col("taken"), F.lit(0)).otherwise(F.coalesce("zw", F.lit(0))),
            "ta": F.coalesce("na", "ta"), "tb": F.coalesce("nb", "tb")})
        moved = _written(moved.select(*NODE, "taken"), "trie-split")
        part = _written(small.unionByName(moved.where("taken").select("a", "b", *VALUES)), "trie-done")
        done = part if done is None else done.unionByName(part)
        now = moved.where("NOT taken").select(NODE)


def ends(path: DataFrame, convs: DataFrame) -> DataFrame:
    """``ea``, ``eb`` and ``ends_sha256`` of every node at which conversations end (zeros: the root)."""
    last = path.where("p = len").select("c", "a", "b").unionByName(
        convs.where("len = 0").select("c", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    rows = last.groupBy("a", "b", F.floor(F.col("c") / PART).alias("k")).agg(ids.alias("ids"))
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "k").select("a", "b", "ids")

    def each(batches) -> Iterator:
        import hashlib

        import pyarrow as pa

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                              names=["ea", "eb", "ends_sha256"])

        now, h = None, None
        for b in batches:
            found = []
            for a, b_, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (a, b_) != now:
                    if h is not None:
                        found.append((*now, h.hexdigest()))
                    now, h = (a, b_), hashlib.sha256()
                else:
                    h.update(b",")
                h.update(part.as_py().encode())
            yield batch(found)
        if h is not None:
            yield batch([(*now, h.hexdigest())])

    return rows.mapInArrow(each, "ea long, eb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", local: int | None = None) -> DataFrame:
    """A row for each node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (code points that storing each node's turn once spares) and ``ends_sha256``."""
    ship_package(conversations.sparkSession)
    turns, convs = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    path = _written(paths(turns, convs), "trie-paths")
    nodes = _written(trie_nodes(path), "trie-forest")
    totals = rolled_up(nodes, path, local).select(F.col("a").alias("ra"), F.col("b").alias("rb"), *VALUES)
    up = nodes.where("kids > 0").select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("rep").alias("up"))
    rows = nodes.join(totals, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))) \
        .join(up, (F.col("pa") == F.col("ua")) & (F.col("pb") == F.col("ub")) & (F.col("depth") > 1), "left")
    rows = rows.select("a", "b", "rep", "depth", "up", "n", "kids", *VALUES)
    whole = nodes.agg(F.count_if(F.col("depth") == 1).alias("kids"), F.count_if(F.col("kids") == 0).alias("leaves"),
                      F.coalesce(F.sum((F.col("n") - 1) * F.col("chars")), F.lit(0)).alias("saved"))
    root = convs.agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 0").crossJoin(whole)
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("a"), zero.alias("b"), "rep", zero.alias("depth"), F.lit(None).cast("long").alias("up"), "n", "kids",
                       F.greatest("leaves", F.lit(1)).cast("long").alias("leaves"), "saved")
    # tops have the root, whose least member is the least of all, as their parent
    least = convs.agg(F.min("c")).scalar()
    every = rows.withColumn("up", F.when(F.col("depth") == 1, least).otherwise(F.col("up"))).unionByName(root)
    none = F.sha2(F.lit(""), 256)
    return every.join(ends(path, convs), (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
