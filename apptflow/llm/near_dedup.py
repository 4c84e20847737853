"""Near duplicates by a chosen-path set similarity join.

After "Scalable and robust set similarity join" (Christiani, Pagh, Sivertsen,
2018): documents are sets of hashed word shingles. In each of ``TREES``
independent trees a document follows the path chosen by its own minwise
tokens: nodes of at most ``WHOLE * LEAF`` documents are compared exhaustively,
larger ones branch two ways by further tokens of the node's choice, at most
``WIDE`` times; what is still large then is compared exhaustively too, since
deeper paths would lose pairs just above the similarity asked for. A pair at that
similarity shares a token with that probability, so it misses all trees with
about (1 - similarity)**TREES; in nodes that branch, two ways a level, it is
expected to meet 2 * similarity times as often after each level. The trees share
one sketch, whose cut-off loses a pair at the similarity itself in all of them
with about 4e-8 (binomial, 64 places, 85 percent).

* Documents with equal sets are one class, found by a pre-aggregated digest;
  only one member takes part.
* Trees run on sketches of ``COORDS`` minwise tokens. A node over ``LEAF`` is
  compared by pairs of blocks of its members. Within a node or such a pair the
  members whose sketches agree in enough places (six standard deviations below
  what the similarity would give), directly or through others, form a cluster;
  equal clusters of several trees are one. A cluster's full sets are compared
  pair by pair in one matrix product, and what is linked comes out as a star:
  as many rows as members, never their pairs.
* In a node that branches every document is compared with ``PIVOTS`` random members; one
  whose sketch is nearly equal to that of a pivot of a smaller identifier, and whose
  link with it the full sets confirm, leaves the node, so a crowd of nearly equal
  texts shrinks at once. The others, unconfirmed ones among them, branch on.
  A document that agrees in enough places with a member that left agrees in at most
  ``COORDS - NEARLY_EQUAL`` fewer with its pivot (sketches differ as a metric), so those
  that do, and are not linked with the pivot themselves, are compared with all
  members that left with it. So leaving loses no link.

Defined results: null text counts as empty; texts without words are linked
with nothing. Rows without an identifier take no part: their component is
null and they are kept. Rows that repeat an identifier with other texts are
documents of their own: each row's component is that of its own text, and only
rows whose text has a smaller identifier in its group go. An
empty table gives no rows. Other columns are ignored by ``near_duplicates`` and
passed through by ``drop_near_duplicates``.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import partitions, prefix_sums, stored
from apptflow.llm.components import connected
from apptflow.session import cut_lineage

WORDS = 5
TREES, COORDS, PIVOTS, WIDE = 8, 64, 4, 3
#: members compared at a time, and how many times as large a node may be to be compared without branching
LEAF, WHOLE = 1024, 8
#: agreeing places of two sketches from which a document leaves its node with the pivot
NEARLY_EQUAL = 58
#: shingles of a cluster whose sets are compared at once, 8 bytes each; two blocks of a larger one may have twice as many
CLUSTER_SHINGLES = 1 << 23
#: tokens compared at a time within a cluster
COLUMNS = 4096

_rng = np.random.default_rng(20240607)
#: random values of the bytes, and odd multipliers: positions in a word, in a shingle, minwise functions
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
MINWISE = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, split at ASCII white space)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    powers = np.multiply.accumulate(np.full(int(sizes.max()), BASE))
    joined = BYTES[np.frombuffer(b"".join(words), np.uint8)]
    joined = joined * powers[np.arange(len(joined)) - np.repeat(starts, sizes)]
    h = _mix(np.add.reduceat(joined, starts))
    n = min(WORDS, len(h))
    m = len(h) - n + 1
    s = np.full(m, n, np.uint64)
    for i in range(n):
        s += h[i:i + m] * PLACES[i]
    return np.unique(_mix(s))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each minwise function, 32 bits."""
    out = np.full(COORDS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(shingles), 1024):
        values = (MINWISE[:, None] * shingles[None, at:at + 1024]) >> np.uint64(32)
        np.minimum(out, values.min(1).astype(np.uint32), out)
    return out


def _lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, kind)))


def text_key(text_col: str) -> Column:
    """Tells the texts of a repeated identifier apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, set_key (digest of the set), roots (the trees' first tokens), sketch.

    A sketch keeps 16 bits of each minwise token, enough within a node; the
    tokens that choose among all documents are whole.
    """
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, roots, rows = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                tokens = minwise(s)[:COORDS if len(s) else 0]
                roots.append(tokens[:TREES].view(np.int32))
                rows.append(tokens.astype(np.uint16).view(np.int16))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.string()),
                 _lists(roots, np.int32), _lists(rows, np.int16)],
                names=["id", "text_key", "n_shingles", "set_key", "roots", "sketch"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return d.mapInArrow(
        sketch, "id long, text_key long, n_shingles long, set_key string, roots array<int>, sketch array<short>")


def _full_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (number of the class), shingles of ``members`` (id, doc, text_key): the documents that stand for classes."""
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # sets are larger than texts
                part = batch.slice(at, 256)
                sets = [shingle_set(t).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(sets, np.int64)], names=["id", "shingles"])

    d = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    d = d.join(members, ["doc", "text_key"]).select("id", "text").mapInArrow(full, "id long, shingles array<long>")
    return d.dropDuplicates(["id"])


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _components(linked: np.ndarray) -> np.ndarray:
    """Number of the first member that each member of a symmetric matrix reaches."""
    labels = np.arange(len(linked))
    while True:
        new = np.minimum(labels, np.where(linked, labels[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _pairs_of_blocks(rows: DataFrame, key: str, blocks: Column, cols: list[str]) -> DataFrame:
    """``key``, id, cols with a new ``key`` for every pair of a group's blocks: each two members meet."""
    d = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
                      lambda b: (b != F.col("block")) | (F.col("blocks") == 1))
    d = d.select(key, "id", *cols, "block", F.explode(others).alias("other"))
    return d.select(F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")).alias(key), "id", *cols)


def _clusters(groups: DataFrame, least: int) -> DataFrame:
    """cluster, id: members of a row of ``groups`` (members: id, side, sketch) whose sketches agree in ``least`` places,
    directly or through others; members of one side are not compared, those without a side are with all."""
    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], [np.empty(0, np.int64)]
            members = batch.column("members")
            each = members.flatten()
            all_ids = each.field("id").to_numpy()
            all_sides = each.field("side").fill_null(-1).to_numpy()
            all_rows = each.field("sketch").flatten().to_numpy().reshape(-1, COORDS)
            ends = np.cumsum([0, *members.value_lengths().to_pylist()])
            for at, end in zip(ends, ends[1:]):
                ids, places = all_ids[at:end], np.ascontiguousarray(all_rows[at:end].T)
                same = np.zeros((len(ids), len(ids)), np.int8)
                for c in range(COORDS):
                    same += places[c, :, None] == places[c, None, :]
                sides = all_sides[at:end]
                labels = _components((same >= least) & ((sides[:, None] != sides[None, :]) | (sides < 0)[:, None]))
                for x in np.unique(labels):
                    own = np.sort(ids[labels == x])
                    if len(own) > 1:
                        key = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
                        keys += [int.from_bytes(key, "little", signed=True)] * len(own)
                        found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(found))],
                                             names=["cluster", "id"])

    return groups.select("members").mapInArrow(cluster, "cluster long, id long")


def _leaf_clusters(nodes: DataFrame, least: int) -> DataFrame:
    """cluster, id: the clusters of the nodes. Nodes over ``LEAF`` are compared by pairs of blocks of their members."""
    blocks = F.when(F.col("size") > LEAF, F.ceil(F.col("size") / max(1, LEAF // 2))).otherwise(1)
    nodes = _pairs_of_blocks(nodes, "node", blocks, ["sketch"])
    member = F.struct("id", F.lit(None).cast("int").alias("side"), "sketch")
    return _clusters(nodes.groupBy("node").agg(F.collect_list(member).alias("members")), least)


def _between_clusters(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """cluster, id: the clusters of members of ``left`` with members of ``right`` (both node, pivot, id, sketch) of the same
    node and pivot, by pairs of blocks of both."""
    keys, half = ["node", "pivot"], max(1, LEAF // 2)
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / half).alias("n0")).join(
        right.groupBy(*keys).agg(F.ceil(F.count("*") / half).alias("n1")), keys)

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        d = rows.join(sizes, keys).withColumn(f"b{side}", F.pmod(F.xxhash64("id"), F.col(f"n{side}")))
        d = d.withColumn(f"b{1 - side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{1 - side}") - 1)))
        return d.select(F.xxhash64(*keys, "b0", "b1").alias("node"), F.struct("id", F.lit(side).alias("side"), "sketch").alias("member"))

    both = dealt(left, 0).unionByName(dealt(right, 1))
    return _clusters(both.groupBy("node").agg(F.collect_list("member").alias("members")), least)


def _pivot_clusters(near: DataFrame) -> DataFrame:
    """cluster, id: each pivot of ``near`` (id, pivot, size of the node) with at most about ``LEAF`` of its members."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / LEAF))
    near = near.select(F.xxhash64("pivot", "size", part).alias("cluster"), F.explode(F.array("pivot", "id")).alias("id"))
    return near.distinct()


def candidate_clusters(sets: DataFrame, least: int, confirm: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """cluster, id of ``sets`` (id, roots, sketch) that meet in a node of some tree and whose sketches agree.

    Also the links by which members left large nodes, as ``confirm`` found them on the full sets.
    """
    at = sets.select("id", F.posexplode("roots").alias("tree", "token"))
    at = at.select(F.xxhash64("tree", "token").alias("node"), "id")
    sizes = at.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    live = stored(at.join(sizes, "node").join(sets.select("id", "sketch"), "id"), "nodes")
    found, known, level = [], [], 0
    while True:
        branches = F.lit(level < WIDE) & (F.col("size") > WHOLE * LEAF)
        clusters = _leaf_clusters(live.filter(~branches), least)
        large = live.filter(branches)
        if level == WIDE or large.isEmpty():
            found.append(clusters)
            break
        pivots = large.groupBy("node").agg(*[
            F.min_by(F.struct("id", "sketch"), F.xxhash64("id", "node", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
        pivots = pivots.select("node", F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivots"))
        met = large.join(pivots, "node").withColumn("met", F.transform("pivots", lambda p: F.struct(
            p["id"].alias("id"), _agreeing(F.col("sketch"), p["sketch"]).alias("same"))))
        met = stored(met.select("node", "id", "sketch", "size", "met"), "met")
        met = met.withColumn("by", F.filter("met", lambda p: (p["same"] >= NEARLY_EQUAL) & (p["id"] < F.col("id"))))
        near = met.filter(F.size("by") > 0).select("node", "id", F.col("by")[0]["id"].alias("pivot"), "sketch")
        # who may agree with a member that left with the pivot; of these, who is linked with the pivot
        touching = met.select("node", "id", "sketch", "size", F.explode("met").alias("p")).select(
            "node", "id", "sketch", "size", F.col("p.id").alias("pivot"), F.col("p.same").alias("same"))
        touching = touching.filter(F.col("id") != F.col("pivot")).filter(F.col("same") >= least - (COORDS - NEARLY_EQUAL))
        close = touching.filter(F.col("same") >= min(least, NEARLY_EQUAL)).select("id", "pivot", "size")
        link = cut_lineage(confirm(_pivot_clusters(close)))
        roots = link.select("a", "b").unionByName(link.select(F.col("b").alias("a"), "b")).distinct()
        linked = cut_lineage(close.select("id", "pivot").distinct()
                             .join(roots.select(F.col("a").alias("pivot"), "b"), "pivot")
                             .join(roots.select(F.col("a").alias("id"), "b"), ["id", "b"]).select("id", "pivot").distinct())
        gone = near.join(linked, ["id", "pivot"], "left_semi")
        apart = touching.join(linked, ["id", "pivot"], "left_anti").select("node", "pivot", "id", "sketch")
        known.append(link)
        found.append(cut_lineage(clusters.distinct()))
        found.append(cut_lineage(_between_clusters(apart, gone.select("node", "pivot", "id", "sketch"), least).distinct()))
        rest = met.join(gone.select("node", "id"), ["node", "id"], "left_anti")
        level += 1
        rest = rest.select("node", "id", "sketch", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
        chosen = F.element_at("sketch", (F.pmod(F.xxhash64("node", "way", F.lit(0)), F.lit(COORDS)) + 1).cast("int"))
        rest = rest.select(F.xxhash64("node", "way", chosen).alias("node"), "id", "sketch")
        sizes = rest.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        live = stored(rest.join(sizes, "node"), "nodes")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct(), known


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a cluster have 100 * intersection >= percent * union."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    of = np.repeat(np.arange(m), sizes)
    tokens, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(number, kind="stable")
    order = order[times[number[order]] > 1]  # tokens of several sets
    both = np.zeros((m, m))
    column = np.cumsum(np.diff(number[order], prepend=-1) != 0) - 1
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((m, COLUMNS), np.float32)
        part[of[order[lo:hi]], column[lo:hi] - at] = 1
        both += part @ part.T
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def confirmed(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within each cluster (cluster, id, n_shingles): every linked member with
    the smallest one. Clusters of more than ``CLUSTER_SHINGLES`` are compared by pairs of blocks, since a group's sets lie
    in one row."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(len(batch)):
                members = batch.column("members").slice(i, 1).flatten()
                ids, lists = members.field("id").to_numpy(), members.field("shingles")
                labels = _components(_linked([x.values.to_numpy() for x in lists], percent))
                at = np.flatnonzero(labels != np.arange(len(labels)))
                a.append(ids[at])
                b.append(ids[labels[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    total = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    d = clusters.join(total, "cluster")
    d = _pairs_of_blocks(d, "cluster", F.ceil(F.col("total") / CLUSTER_SHINGLES), [])
    d = d.join(sets, "id").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("id", "shingles"))).alias("members"))
    return d.select("members").mapInArrow(confirm, "a long, b long")


def links(docs: DataFrame, classes: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """node, root: numbers of the classes linked, directly or through others, with one of a smaller number."""
    s = percent / 100
    least = math.floor(COORDS * s - 6 * math.sqrt(COORDS * s * (1 - s)))
    named = classes.select("id", "doc", "text_key")
    sizes = classes.select("id", "n_shingles")

    def confirm(clusters: DataFrame) -> DataFrame:
        members = clusters.select("id").distinct().join(named, "id")
        return confirmed(clusters.join(sizes, "id"), _full_sets(docs, members, id_col, text_col), percent)

    clusters, known = candidate_clusters(classes.select("id", "roots", "sketch"), least, confirm)
    found = confirm(cut_lineage(clusters))
    for more in known:
        found = found.unionByName(more)
    return connected(found)


def _placed(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, component, kept for every row of ``docs``."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    classes = (rows.filter("id IS NOT NULL AND n_shingles > 0").groupBy("set_key")
               .agg(F.min(F.struct("id", "text_key")).alias("least"), F.count("*").alias("size"),
                    F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"),
                    F.first("sketch").alias("sketch"))
               .select("set_key", F.col("least.id").alias("doc"), "least.text_key", "size", "n_shingles", "roots", "sketch"))
    # classes are numbered in the order of their smallest identifiers, which several may have
    classes = stored(prefix_sums(classes, ["doc", "set_key"], {"id": None}), "classes")
    found = links(docs, classes, percent, id_col, text_col)
    roots = classes.select(F.col("id").alias("root"), F.col("doc").alias("root_doc"))
    named = (classes.select("id", "doc", "set_key", "size").join(found, F.col("id") == F.col("node"), "left")
             .filter("node IS NOT NULL OR size > 1").join(roots, "root", "left")
             .select("set_key", "size", F.coalesce("root_doc", "doc").alias("component")))
    named = cut_lineage(named)
    # sets that a large share of the rows have: fewer than 2 * partitions of them; their rows need no join by key
    n, parts = rows.count(), partitions(docs.sparkSession)
    is_hot = F.col("size") * 2 * parts > max(n, 2 * parts)
    hot = named.filter(is_hot).select(F.col("set_key").alias("hot_key"), F.col("component").alias("hot"))
    rest = named.filter(~is_hot).select(F.col("set_key").alias("key"), "component")
    d = rows.select("id", "text_key", "n_shingles", "set_key").join(
        F.broadcast(hot), F.col("set_key") == F.col("hot_key"), "left")
    d = d.withColumn("key", F.when(F.col("hot_key").isNull() & F.col("id").isNotNull() & (F.col("n_shingles") > 0),
                                   F.col("set_key")).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string"))))
    d = d.join(rest, "key", "left")
    named_id = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("hot", "component", "id")).otherwise(F.col("id"))
    return d.select("id", "text_key", "n_shingles", named_id.alias("component"),
                    F.coalesce(F.col("id") == named_id, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``."""
    return _placed(docs, percent, id_col, text_col).select(
        F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller identifier, with all their columns."""
    gone = _placed(docs, percent, id_col, text_col).filter(~F.col("kept")).select(
        F.col("id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct()
    same = (docs[id_col].cast("long") == gone["_gone"]) & (text_key(text_col) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")
