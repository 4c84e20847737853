"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the first ``h`` turns of a base conversation, then its
own turns after its own first ``h``. Texts are never put together: a sequence
of turns has the product

    F(k) = t_0 + t_1 p + ... + t_(k-1) p^(k-1)  (mod P)

of its turns' hashes t, a monoid under concatenation, F(a b) = F(a) + p^|a| F(b),
in three lanes of 31-bit primes. Each stored conversation gets its own prefix
products once; the prefix of a rebuilt one is the product of a base head (at
most ``HEAD - 1`` turns) and of an own suffix, which is a difference of two own
products, shifted. A prefix refers to the stored turn that ends it.

* Turns, without their texts, are range-partitioned by (conversation, turn) and
  sorted; a task streams its partition and carries the product along. A
  conversation that lies in several partitions, one of a third of all rows
  included, is put together from the products of its pieces; there are fewer of
  those pieces than twice the partitions.
* Prefixes are grouped by (depth, product). The members of a group must agree in
  their parents' products and in the SHA-256 (120 bits of it) of role and text of
  the turns that they refer to; where one does not, all products are made anew
  with the next bases.
* A node is owned by its smallest member. Once a conversation owns a prefix it
  owns all longer ones, so the first depth it owns tells the distinct nodes, leaves
  and children below every node without walking the trie level by level: sums
  over a node's members.
* The identifiers that end at a node are sorted over range partitions, joined in
  pieces of ``PIECE``, and the pieces streamed through SHA-256, so memory does not
  grow with a node.

Defined results: null role or text counts as empty. Rows without a conversation
identifier take no part. Turns go by turn (null first), then role, then SHA-256 of
role and text; equal rows are turns of their own. A conversation without rebuilt
turns is a member of the root alone. An empty table gives no rows, no root
either. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import SPACES, crc32_text, stored
from apptflow.session import cut_lineage

WORD = SPACES.replace("[", "[^", 1)
#: heads have 0 to HEAD - 1 turns; conversations share the base of their group of GROUP identifiers
HEAD = 4
GROUP = 20
#: the largest primes below 2**31, a lane each
PRIMES = (2147483647, 2147483629, 2147483587)
#: bases of each attempt
BASES = ((1103515245, 1664525917, 1812433253), (1566083941, 1181783497, 1289706101), (1099087573, 1583458089, 1332534557))
PIECE = 4096
LANES = range(len(PRIMES))


def stored_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """c, turn, role, sha, words and the hash of each lane, for every row, without its text."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    d = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.col("turn").alias("turn"), role.alias("role"), sha.alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return stored(d, "turns")


def _in_order(turns: DataFrame) -> DataFrame:
    """Rows sorted by conversation and turn over all partitions; ``part`` numbers those."""
    keys = ["c", "turn", "role", "sha"]
    d = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    d = cut_lineage(d.withColumn("_at", F.monotonically_increasing_id()))
    half = [F.conv(F.substring("sha", 1 + 15 * k, 15), 16, 10).cast("long").alias(f"sha{k}") for k in (0, 1)]
    hashes = [F.pmod(F.xxhash64("sha", F.lit(k)), F.lit(p)).alias(f"t{k}") for k, p in enumerate(PRIMES)]
    return d.select("c", F.shiftright("_at", 33).alias("part"), *half, "words", *hashes)


def power(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    out, square = np.ones(len(exponent), np.int64), np.int64(base)
    for bit in range(int(exponent.max()).bit_length() if len(exponent) else 0):
        out = np.where(exponent >> bit & 1, out * square % prime, out)
        square = square * square % prime
    return out


def _products(rows: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """For each turn, of the turns of its conversation in its partition: ``local`` (number before it), product before
    and after it (g, f) and words before it."""
    schema = "c long, part long, sha0 long, sha1 long, words long, local long, words_before long, " + ", ".join(
        f"{x}{k} long" for x in "gf" for k in LANES)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, said, carried = None, 0, 0, [0 for _ in LANES]
        for batch in batches:
            if not batch.num_rows:
                continue
            c, words = batch.column("c").to_numpy(), batch.column("words").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
            goes_on = c[0] == last

            def along(values: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray]:
                """Sums of the run before and after each row; ``carry`` is what the first run brings along."""
                ends = np.cumsum(values)
                ahead = (ends - values)[starts]
                if goes_on:
                    ahead[0] -= carry
                return ends - values - ahead[run], ends - ahead[run]

            local, upto = along(np.ones(len(c), np.int64), n)
            before, heard = along(words, said)
            sums = []
            for k, p in enumerate(PRIMES):
                term = batch.column(f"t{k}").to_numpy() * power(bases[k], local, p) % p
                sums.append([x % p for x in along(term, carried[k])])  # below 2**63 for 2**32 rows a batch
            last, n, said, carried = c[-1], int(upto[-1]), int(heard[-1]), [int(f[-1]) for _, f in sums]
            cols = [*(batch.column(x) for x in ("c", "part", "sha0", "sha1", "words")), pa.array(local), pa.array(before),
                    *(pa.array(g) for g, _ in sums), *(pa.array(f) for _, f in sums)]
            yield pa.RecordBatch.from_arrays(cols, names=["c", "part", "sha0", "sha1", "words", "local", "words_before",
                                                          *(f"{x}{k}" for x in "gf" for k in LANES)])

    return stored(rows.mapInArrow(stream, schema), "products")


def _joined(rows: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """``local``, products and words of whole conversations: the pieces that lie in several partitions combined."""
    spark = rows.sparkSession
    torn = (rows.groupBy("c").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b")
            .select("c"))  # fewer than there are partitions
    last = F.max_by(F.struct("words_before", "words", *[f"f{k}" for k in LANES]), "local")
    pieces = (rows.join(F.broadcast(torn), "c").groupBy("c", "part")
              .agg(F.count("*").alias("n"), last.alias("z")).orderBy("c", "part").collect())  # under twice the partitions
    carries, before = [], None
    for r in pieces:
        if before is None or before[0] != r["c"]:
            before = (r["c"], 0, 0, [0 for _ in LANES])
        shift = [pow(bases[k], before[1], p) for k, p in enumerate(PRIMES)]
        carries.append((r["c"], r["part"], before[1], before[2], *before[3], *shift))
        product = [(before[3][k] + shift[k] * r["z"][f"f{k}"]) % p for k, p in enumerate(PRIMES)]
        before = (r["c"], before[1] + r["n"], before[2] + r["z"]["words_before"] + r["z"]["words"], product)
    names = ["n0", "w0", *(f"f0{k}" for k in LANES), *(f"p0{k}" for k in LANES)]
    table = spark.createDataFrame(carries, "c long, part long, " + ", ".join(f"{x} long" for x in names))
    d = rows.join(F.broadcast(table), ["c", "part"], "left")

    def whole(x: str, k: int) -> Column:
        return F.when(F.col("n0").isNull(), F.col(f"{x}{k}")).otherwise(
            (F.col(f"f0{k}") + F.col(f"p0{k}") * F.col(f"{x}{k}")) % PRIMES[k]).alias(f"{x}{k}")

    zero = F.lit(0).cast("long")
    return d.select("c", (F.col("local") + F.coalesce("n0", zero)).alias("i"), "sha0", "sha1", "words",
                    (F.col("words_before") + F.coalesce("w0", zero)).alias("words_before"),
                    *[whole(x, k) for x in "gf" for k in LANES])


def rebuilt_prefixes(turns: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """c, d, n_turns, f (product), g (parent's product), sha, words, words_before and the turn referred to, for every
    prefix of every rebuilt conversation."""
    rows = _joined(turns, bases)
    cols = ["i", "sha0", "sha1", "words", "words_before", *(f"{x}{k}" for x in "gf" for k in LANES)]
    heads = rows.groupBy("c").agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("i") < HEAD - 1, F.struct(*cols)))).alias("head"))  # HEAD - 1 at most
    heads = stored(heads.withColumns({
        "h": F.pmod(crc32_text(F.col("c")), F.lit(HEAD)).cast("int"), "b": F.col("c") - F.col("c") % GROUP}), "heads")
    bases_of = heads.select(F.col("c").alias("b"), F.col("head").alias("base"))
    convs = heads.join(bases_of, "b", "left")
    convs = convs.withColumns({"own": F.least("h", "n").cast("int"),
                               "hb": F.least("h", F.coalesce(F.size("base"), F.lit(0))).cast("int")})

    def head_value(array: str, count: str, value: Column) -> Column:
        return F.when(F.col(count) > 0, value).otherwise(F.lit(0).cast("long"))

    def last(array: str, count: str, field: str) -> Column:
        return head_value(array, count, F.expr(f"{array}[{count} - 1].{field}"))

    def spoken(array: str, count: str) -> Column:
        return head_value(array, count, F.expr(f"{array}[{count} - 1].words_before + {array}[{count} - 1].words"))

    convs = stored(convs.select(
        "c", "h", "b", "hb", (F.col("hb") + F.col("n") - F.col("own")).alias("n_turns"),
        F.expr("slice(base, 1, hb)").alias("base"),
        *[last("base", "hb", f"f{k}").alias(f"base{k}") for k in LANES],
        *[last("head", "own", f"f{k}").alias(f"own{k}") for k in LANES],
        (spoken("base", "hb") - spoken("head", "own")).alias("more_words")), "rebuilt")

    out = ["c", "d", "n_turns", "words", "words_before", "sha0", "sha1", "turn_conv_id", "turn_index",
           *(f"{x}{k}" for x in "gf" for k in LANES)]
    zero = F.lit(0).cast("long")
    root = convs.select("c", zero.alias("d"), "n_turns", *[zero.alias(x) for x in out[3:7]],
                        F.lit(None).cast("long").alias("turn_conv_id"), F.lit(None).cast("long").alias("turn_index"),
                        *[zero.alias(x) for x in out[9:]])
    head = convs.select("c", "n_turns", "b", F.explode("base").alias("x")).select(
        "c", "n_turns", "b", "x.*").withColumns(
        {"d": F.col("i") + 1, "turn_conv_id": F.col("b"), "turn_index": F.col("i")}).select(*out)
    own = rows.join(convs.drop("base", "b"), "c").filter("i >= h")

    def shifted(x: str, k: int) -> Column:
        p = PRIMES[k]
        by = F.element_at(F.array(*[F.lit(pow(pow(bases[k], -1, p), s, p)) for s in range(HEAD)]),
                          F.col("h") - F.col("hb") + 1)
        return ((F.col(f"base{k}") + by * F.pmod(F.col(f"{x}{k}") - F.col(f"own{k}"), F.lit(p)) % p) % p).alias(f"{x}{k}")

    own = own.select("c", (F.col("hb") + F.col("i") - F.col("h") + 1).alias("d"), "n_turns", "words",
                     (F.col("words_before") + F.col("more_words")).alias("words_before"), "sha0", "sha1",
                     F.col("c").alias("turn_conv_id"), F.col("i").alias("turn_index"),
                     *[shifted(x, k) for x in "gf" for k in LANES])
    return root.unionByName(head).unionByName(own)


def grouped(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """The groups of equal (depth, product), and whether the members of each refer to equal turns and parents."""
    same = ["sha0", "sha1", *(f"g{k}" for k in LANES)]
    groups = stored(prefixes.groupBy("d", *[f"f{k}" for k in LANES]).agg(
        F.count("*").alias("n_convs"), F.min("c").alias("owner"), F.max("n_turns").alias("longest"),
        *[F.min(x).alias(f"min_{x}") for x in same], *[F.max(x).alias(f"max_{x}") for x in same]), "groups")
    differ = " OR ".join(f"min_{x} <> max_{x}" for x in same)
    return groups.select("d", *[f"f{k}" for k in LANES], "n_convs", "owner", "longest"), groups.filter(differ).isEmpty()


def _ends(members: DataFrame) -> DataFrame:
    """owner, d, ends_sha256: digest of the identifiers that end at a node, ascending, between commas."""

    def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple[int, int], list]]:
        for batch in batches:
            owner, d, value = (batch.column(x).to_pylist() for x in names)
            at = 0
            while at < len(owner):
                to = at
                while to < len(owner) and to - at < PIECE and (owner[to], d[to]) == (owner[at], d[at]):
                    to += 1
                yield (owner[at], d[at]), value[at:to]
                at = to

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def piece() -> tuple:
            return *key, held[0], ",".join(map(str, held[:PIECE]))

        out = []
        for k, ids in runs(batches, ["owner", "d", "c"]):
            if k != key and held:
                out.append(piece())
                held = []
            key = k
            held += ids
            if len(held) >= PIECE:
                out.append(piece())
                held = held[PIECE:]
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if held:
            out.append(piece())
        yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)],
                                          names=["owner", "d", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for k, parts in runs(batches, ["owner", "d", "ids"]):
            if k != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
                sha.update(parts.pop(0).encode())
            for part in parts:
                sha.update(b"," + part.encode())
        if key is not None:
            out.append((*key, sha.hexdigest()))
        cols = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                          pa.array(cols[2], pa.string())], names=["owner", "d", "ends_sha256"])

    d = members.select("owner", "d", "c").repartitionByRange("owner", "d", "c").sortWithinPartitions("owner", "d", "c")
    d = d.mapInArrow(pieces, "owner long, d long, first long, ids string")
    d = d.repartition("owner", "d").sortWithinPartitions("owner", "d", "first")
    return d.mapInArrow(digests, "owner long, d long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the stored turn that ends it (turn_conv_id, turn_index)."""
    rows = _in_order(stored_turns(conversations, id_col))
    for bases in BASES:
        prefixes = stored(rebuilt_prefixes(_products(rows, bases), bases), "prefixes")
        groups, sound = grouped(prefixes)
        if sound:
            break
    else:
        raise RuntimeError("products of different prefixes are equal for all bases")
    members = prefixes.join(groups, ["d", *[f"f{k}" for k in LANES]]).select(
        "c", "d", "n_turns", "owner", "longest", "words", "words_before", "turn_conv_id", "turn_index")
    members = stored(members, "members")

    owned = F.col("owner") == F.col("c")
    firsts = stored(members.groupBy("c").agg(
        F.min(F.when(owned, F.col("d"))).alias("first_d"),
        F.min(F.when(owned, F.col("words_before"))).alias("first_words"),
        F.max(F.col("words_before") + F.col("words")).alias("all_words"),
        F.max_by("owner", F.when(~owned, F.col("d"))).alias("above"),
        F.max(owned & (F.col("d") == F.col("n_turns")) & (F.col("d") == F.col("longest"))).alias("is_leaf")), "firsts")
    d = members.join(firsts, "c")
    shared = F.coalesce("first_words", "all_words") - F.col("words_before")  # words of what others own, from here on
    next_owned = (F.col("first_d") <= F.col("d") + 1) & (F.col("d") < F.col("n_turns"))
    parent = F.when(F.col("d") > 0, F.when(F.col("first_d") < F.col("d"), F.col("c")).otherwise(F.col("above")))
    nodes = d.groupBy("owner", "d").agg(
        F.max(F.when(owned, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(F.when(next_owned, 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), shared)).alias("saved_tokens"),
        F.max(F.when(owned, F.col("turn_conv_id"))).alias("turn_conv_id"),
        F.max(F.when(owned, F.col("turn_index"))).alias("turn_index"))
    nodes = nodes.join(_ends(members.filter("d = n_turns")), ["owner", "d"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
                        "turn_conv_id", "turn_index")
