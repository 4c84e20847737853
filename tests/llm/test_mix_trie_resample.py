"""Prefix trie, importance resampling and source mixing: edge rows, skew, brute force."""
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apptflow.llm import mixing, prefix_trie, queries as q, resampling
from test_contracts import EDGES, canon, duck, edge_docs, run_sql


def run_conversations_sql(rows):
    con = duck("/root/testdata/sf0.001")
    con.execute("DROP VIEW conversations")
    con.register("conversations", rows.select("conv_id", "turn", "role", "text").toArrow())
    return con.execute(q.SQL["op11_conversation_prefix_trie"]).df()


def trie(rows):
    return prefix_trie.prefix_trie(rows).drop("turn_conv_id", "turn_index")


CLASHING = "conv_id long, turn long, role string, text string, c long, d int, owner string, n_convs int"


def said(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, "x", 7) for r in rows], CLASHING)


def brute_trie(rows):
    """The contract, told turn by turn."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            sha = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            convs.setdefault(c, []).append(((t is not None, t or 0, r, sha), (r, x)))
    own = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    out = []
    for node, cs in members.items():
        below = [v for v in members if v[:len(node)] == node]
        kids = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(len(w) == len(v) + 1 and w[:len(v)] == v for w in members)]
        saved = sum((len(members[v]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) for v in below if v)
        text = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def got_trie(rows):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in trie(rows).collect())


TALK = [(1, 0, "user", "hi  there"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (2, 0, "user", "hi  there"),
        (2, 1, "assistant", "yes"), (2, None, None, None), (3, None, None, None), (None, 0, "user", "nobody"),
        (20, 5, "user", "tie"), (20, 5, "assistant", "tie"), (20, 5, "assistant", "tie"), (21, 0, "", ""),
        (22, 0, "user", "w" * 40_000 + " end"), (22, 1, "user", "b"), (22, 2, "user", "b"), (22, 3, "user", "b"),
        (-5, 0, "user", "below"), (-25, 0, "a", "b"), (-20, 0, "a", "b"), (0, 0, "user", "hi  there"), (0, 1, "x", "y"),
        (40, 0, "ab", "c"), (41, 0, "a", "bc"), (42, 0, "a", "bc"), (43, 0, "a", "bc"), (44, 0, "a", "bc"), (45, 9, "a", "bc")]


def test_trie_edges(spark):
    rows = said(spark, TALK)
    got = got_trie(rows)
    assert got == brute_trie(TALK)
    assert canon(trie(rows).toPandas()) == canon(run_conversations_sql(rows))
    assert trie(rows.filter("false")).count() == 0
    assert trie(rows.filter("conv_id IS NULL")).count() == 0


def copies(n, seed):
    """Groups of conversations that begin alike, one conversation of a third of all rows, and hundreds of copies."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        like = rnd.randrange(3) if c % 3 else 9
        for t in range(rnd.randint(0, 6)):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {like} {t}" if rnd.random() < 0.9 else f"own {c}"))
    rows += [(n, t, "user", f"{t % 7} words more") for t in range(len(rows) // 2)]
    rnd.shuffle(rows)
    return rows


def test_trie_against_brute_force(spark):
    rows = copies(150, 3)
    assert got_trie(said(spark, rows).repartition(5)) == brute_trie(rows)


def test_trie_of_torn_conversations(spark, monkeypatch):
    """A long conversation lies in several partitions and ends are joined in small pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = copies(60, 5)
        parts = prefix_trie._in_order(prefix_trie.stored_turns(said(spark, rows)))
        assert parts.groupBy("c").agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0] > 2
        assert got_trie(said(spark, rows)) == brute_trie(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_trie_makes_products_anew(spark, monkeypatch):
    """With a base of 0 a product is its first turn alone: groups do not agree, the next bases are taken."""
    monkeypatch.setattr(prefix_trie, "BASES", ((2147483647, 2147483629, 2147483587), prefix_trie.BASES[0]))
    monkeypatch.setattr(prefix_trie, "pow", lambda b, e, p: 1 if b % p == 0 else pow(b, e, p), raising=False)
    rows = copies(40, 8)
    assert got_trie(said(spark, rows)) == brute_trie(rows)


def test_trie_refers_to_stored_turns(spark):
    rows = said(spark, TALK)
    nodes = prefix_trie.prefix_trie(rows).collect()
    by_root = {(r["conv_id"], r["depth"]): (r["turn_conv_id"], r["turn_index"]) for r in nodes}
    assert all((t is None) == (d == 0) for (_, d), (t, _) in by_root.items())
    h = zlib.crc32(b"22") % 4
    assert by_root[22, 4 - h + min(h, 3)] == (22, 3)


# --- importance resampling ---------------------------------------------------

def brute_features(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def random_texts(n, seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choices("abcXYZ 019-_\n\té你ü   ", k=rnd.randint(0, 200))) for _ in range(n)]
    return [*texts, None, "", "\n\n", "w" * 100 + " " + "v" * 49 + " " + "u" * 48 + "\nq", "a\nb c\n\nd", "A_b"]


def test_features_against_zlib(monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 700)
    texts = random_texts(300, 1)
    got = [[] for _ in texts]
    for array in (pa.array(texts), pa.array([None, "zz", *texts]).slice(2)):
        got = [[] for _ in texts]
        for first, w in resampling.chunks(array):
            for i, b in zip(*resampling.features(w, 997)):
                got[first + i].append(int(b))
        want = [sorted(zlib.crc32(f.encode()) % 997 for f in brute_features(t)[1]) for t in texts]
        assert [sorted(g) for g in got] == want


def test_bucket_counts_of_repeated_lines(spark):
    """Lines that repeat are hashed once and count as often as they occur, pairs over line ends included."""
    texts = random_texts(60, 2) + ["the same line\nthe same line\r\nthe end"] * 50 + ["one", "two"] * 20
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    counts = resampling.bucket_counts(df, buckets=499)
    want = [0] * 499
    for t in texts:
        for f in brute_features(t)[1]:
            want[zlib.crc32(f.encode()) % 499] += 1
    assert counts.tolist() == want


def test_resample_edges(spark):
    long = [(20 + i, " ".join(random.Random(i).choices(["the", "End", "of", "a b", "line\n", "x-y"], k=30))) for i in range(40)]
    docs = edge_docs(spark, EDGES + long + [long[3], (None, long[3][1]), (None, long[3][1])])
    target = spark.table("benchmark") if spark.catalog.tableExists("benchmark") else spark.read.parquet(
        "/root/testdata/sf0.001/benchmark.parquet")
    got = resampling.resample(docs, target, 25, 20, 7).select("doc_id", "n_features", "weight", "score", "rank")
    assert canon(got.toPandas()) == canon(run_sql(spark, "op12_importance_resampling", docs))
    assert resampling.resample(edge_docs(spark, []), target, 25, 20).count() == 0
    none = resampling.resample(docs, target.filter("false"), 100, 0)
    ranks = sorted(r["rank"] for r in none.collect())
    assert ranks == list(range(1, docs.count() + 1))


def test_resampling_moves_towards_the_target(spark):
    """Texts like the target's are drawn far more often than others."""
    rnd = random.Random(4)
    like, unlike = [f"t{i}" for i in range(50)], [f"u{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(like if i % 4 == 0 else unlike, k=40))) for i in range(400)],
                                 "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rnd.choices(like, k=200)),) for _ in range(5)], "text string")
    drawn = resampling.resample(docs, target, 20, 20).filter("rank IS NOT NULL").toPandas()
    assert len(drawn) == 80 and (drawn.doc_id % 4 == 0).mean() > 0.6  # a quarter of all rows


# --- source mixing -----------------------------------------------------------

def brute_targets(sizes, weights, percent, most):
    """The excess over the caps reshared round by round."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()) * percent / 100, set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 1, 5, 40, 1000, 50_000]) for i in range(rnd.randint(1, 25))} | {None: 77}
    df = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()],
                               "no_source boolean, src string, source_size long")
    got = {None if r["no_source"] else r["src"]: r["target"] for r in mixing.source_targets(df, [3, 1, 2], 150, 2).collect()}
    want = brute_targets(sizes, [3, 1, 2], 150, 2)
    assert got == pytest.approx(want)


def mixed_edges(spark):
    rows = EDGES + [(30 + i, f"many words of a source number {i} " * (i % 5 + 1)) for i in range(60)]
    return edge_docs(spark, rows)


def test_mix_edges(spark):
    docs = mixed_edges(spark)
    got = mixing.mix(docs, [3, 1, 2], 150, 2).toPandas()
    sql = run_sql(spark, "op13_weighted_mix", docs)
    assert canon(got[["doc_id", "size", "source_size", "target", "taken"]]) == canon(sql)
    assert (got.taken <= 2 * got["size"]).all()
    for _, x in got.groupby(got.source.fillna("null")):
        assert abs(x.taken.sum() - x.target.iloc[0]) < 1
    assert mixing.mix(edge_docs(spark, []), [3, 1, 2]).count() == 0
    wordless = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(wordless, [1], 150).collect()] == [0, 0]


def test_mix_reruns_agree(spark):
    docs = mixed_edges(spark)
    again = mixing.mix(docs.repartition(7), [3, 1, 2], 150, 2).toPandas()
    assert canon(mixing.mix(docs, [3, 1, 2], 150, 2).toPandas()) == canon(again)


def test_mix_hot_source(spark):
    """A source of nine tenths of all rows is cut to the word too."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").otherwise(
        F.concat(F.lit("s"), F.col("id") % 3)).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 7).cast("int")).alias("text"))
    sums = mixing.mix(docs, [1, 2, 3], 100, 2).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"))
    assert all(r["n"] == int(r["t"]) for r in sums.collect())


def test_mix_prefers_quality(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"),
                                    F.when(F.col("id") % 2 == 0, 9.0).otherwise(1.0).alias("good"))
    got = mixing.mix(docs, [1], 50, 2, quality=F.col("good")).toPandas()
    good = got[got.doc_id % 2 == 0].taken.sum() / got.taken.sum()
    # without replacement, half of all drawn: 1 - e**(-9 t) of the good ones, 1 - e**(-t) of the others, 1 together
    assert 0.78 < good < 0.9


def test_mixed_documents(spark):
    """The rows of the mix: whole copies first, the last one cut after its words, columns passed through."""
    docs = mixed_edges(spark)
    plan = mixing.mix(docs, [3, 1, 2], 150, 2).toPandas()
    rows = mixing.mixed_documents(docs, [3, 1, 2], 150, 2)
    assert rows.columns == [*docs.columns, "epoch"]
    words = rows.select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).toPandas()
    assert words.n.sum() == plan.taken.sum() and (words.n > 0).all()
    assert words.dropna().groupby("doc_id").n.sum().to_dict() == {
        k: v for k, v in plan.dropna(subset=["doc_id"]).groupby("doc_id").taken.sum().to_dict().items() if v}
