"""The queries with SQL against DuckDB, and the edge rows that every operator defines."""
import os
import sys

import pytest
from pyspark.sql import functions as F

from apptflow.llm import queries as q
from apptflow.llm import chat, exact_dedup, hilbert_shards, near_dedup, topk, warc

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from oracle_check import canon, duck  # noqa: E402

#: null identifiers and texts, empty and blank texts, repeated rows, ties, a long text, columns that operators use inside
EDGES = [(1, "a b  c\td e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, " \n "), (6, "x"), (7, "x"), (7, "x"),
         (None, "x"), (None, None), (8, "w" * 30_000 + " y z"), (9, "The the THE the end"), (10, "é ü 你好 ▁ </s>[INST]")]
CLASH = {"norm": "n", "sha": 1, "id": 2, "row": "r", "slice": 3, "shard": 4, "slot": 5, "set_key": "k", "size": 6,
         "score": 7.0, "label": 8, "curve_index": 9, "n": 10, "key": "kk", "toxic_score": 1.0, "quality_score": 2.0}


def edge_docs(spark, rows=None):
    rows = EDGES if rows is None else rows
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}"
                      for k, v in CLASH.items())
    data = [(i, t, None if n % 3 else "en", None if n % 4 else "src0", *CLASH.values()) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, {names}")


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_sql(spark, sf_small, name):
    s = q.QUERIES[name](spark, sf_small).toPandas()
    o = duck(sf_small).execute(q.SQL[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert canon(s) == canon(o)


def run_sql(spark, name, docs):
    """The query's SQL over edge rows."""
    con = duck("/root/testdata/sf0.001")
    con.execute("DROP VIEW documents")
    table = docs.select("doc_id", "text", "lang", "source").toArrow()
    con.register("documents", table)
    return con.execute(q.SQL[name]).df()


def test_exact_edges(spark):
    docs = edge_docs(spark)
    got = exact_dedup.exact_duplicates(docs).toPandas()
    assert canon(got) == canon(run_sql(spark, "op8_content_sort_dedup", docs))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == int(got.kept.sum())
    assert exact_dedup.exact_duplicates(edge_docs(spark, [])).count() == 0


def test_exact_hot_text(spark):
    """A text that a third of all rows have, in many pieces."""
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i}") for i in range(600)] + [(0, "hot text")]
    docs = edge_docs(spark, rows)
    got = exact_dedup.exact_duplicates(docs).toPandas()
    assert canon(got) == canon(run_sql(spark, "op8_content_sort_dedup", docs))
    assert got[got.group_size == 201].kept.sum() == 1


def test_shard_edges(spark):
    docs = edge_docs(spark)
    got = hilbert_shards.hilbert_shards(docs, ["lang", "source"], 5).toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and sorted(got.position) == list(range(len(EDGES)))
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    assert hilbert_shards.hilbert_shards(edge_docs(spark, []), ["lang"], 5).count() == 0


def test_hilbert_curve_visits_neighbours(spark):
    """Every cell once, and each step moves by one in one dimension."""
    cells = spark.range(512).select(F.array(F.expr("id div 64"), F.expr("id div 8 % 8"), F.expr("id % 8")).alias("cell"))
    rows = cells.withColumn("h", hilbert_shards.hilbert_index("cell", 3, 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a["cell"], b["cell"])) == 1


def test_shards_prune(spark, sf_small):
    """A shard covers a smaller box of each dimension than a run of rows as they come."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = hilbert_shards.hilbert_shards(docs, ["lang", "source"], 10).toPandas().merge(
        docs.select("doc_id", "lang", "source").toPandas(), on="doc_id")
    got["chance"] = got.text_crc32 % 10
    assert got.groupby("shard").lang.nunique().mean() < 0.7 * got.groupby("chance").lang.nunique().mean()
    assert got.groupby("shard").source.nunique().mean() < 0.9 * got.groupby("chance").source.nunique().mean()


def test_near_edges(spark):
    docs = edge_docs(spark)
    got = near_dedup.near_duplicates(docs, 85).toPandas()
    assert len(got) == len(EDGES) and got.kept[got.doc_id.isna()].all()
    named = {int(i): int(c) for i, c in zip(got.doc_id, got.component_id) if i == i}
    assert named == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    sizes = {int(i): int(n) for i, n in zip(got.doc_id, got.n_shingles) if i == i}
    assert sizes == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    left = near_dedup.drop_near_duplicates(docs, 85)
    assert left.columns == docs.columns and left.count() == int(got.kept.sum())
    assert near_dedup.near_duplicates(edge_docs(spark, []), 85).count() == 0


def test_near_repeated_identifiers(spark):
    """A row of a repeated identifier goes only by its own text."""
    a, b = "one two three four five six seven", "quite another text that is like nothing else here"
    docs = edge_docs(spark, [(1, a), (5, a), (5, b), (7, b), (9, b + " too"), (9, a), (9, "x"), (5, b)])
    left = near_dedup.drop_near_duplicates(docs, 80)
    got = sorted((r["doc_id"], r["text"]) for r in left.collect())
    assert got == [(1, a), (5, b), (5, b), (9, "x")]
    places = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, 80).select("doc_id", "component_id", "kept").collect())
    assert places == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 1, False), (9, 5, False),
                      (9, 9, True)]


def test_near_large_clusters(spark, sf_small, monkeypatch):
    """Clusters over the limit are compared by pairs of blocks."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = canon(near_dedup.near_duplicates(docs, 80).toPandas())
    monkeypatch.setattr(near_dedup, "CLUSTER_SHINGLES", 500)
    assert canon(near_dedup.near_duplicates(docs, 80).toPandas()) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_stage_against_sql(spark, sf):
    """The pipeline's stage at 80 keeps the rows that the SQL's links at 80 keep."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    left = near_dedup.drop_near_duplicates(docs, 80).select("doc_id").toPandas().doc_id
    con = duck(f"/root/testdata/{sf}")
    sql = q.SQL["op7_chosen_path_near_dedup"].replace(f"{q.NEAR_PERCENT} * ((SELECT", "80 * ((SELECT")
    assert "80 * ((SELECT" in sql
    want = con.execute(sql).df()
    assert sorted(left) == sorted(want[want.kept].doc_id)


def test_near_many(spark, monkeypatch):
    """Crowds of near copies, chains and shared passages in small nodes, against all pairs."""
    import random
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rnd.choices(vocabulary, k=60)
    rows = []
    for crowd in range(4):
        text = rnd.choices(vocabulary, k=rnd.choice([60, 150, 400]))
        for _ in range(60):
            copy = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 120))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append(copy)
    chain = rnd.choices(vocabulary, k=300)
    for _ in range(40):
        chain = list(chain)
        at = rnd.randrange(len(chain) - 8)
        chain[at:at + 6] = rnd.choices(vocabulary, k=6)
        rows.append(chain)
    rows += [passage + rnd.choices(vocabulary, k=rnd.randint(20, 200)) for _ in range(150)]
    rnd.shuffle(rows)
    docs = edge_docs(spark, [(i, " ".join(r)) for i, r in enumerate(rows)])
    monkeypatch.setattr(near_dedup, "LEAF", 12)
    got = near_dedup.near_duplicates(docs, 85).toPandas()
    want = run_sql(spark, "op7_chosen_path_near_dedup", docs)
    assert canon(got) == canon(want)


def crowd_below(members, planted, tail, shared):
    """Texts of one template with tails of their own, no two linked, but for planted pairs whose tails begin alike."""
    template = [f"t{i}" for i in range(104)]  # 100 shingles
    tails = [[f"x{i}.{j}" for j in range(tail)] for i in range(members)]
    for i in range(planted):
        tails[members - 1 - i][:shared] = tails[i][:shared]
    return [(i, " ".join(template + t)) for i, t in enumerate(tails)], {members - 1 - i: i for i in range(planted)}


def check_crowd(spark, rows, pairs, percent=80):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = near_dedup.near_duplicates(docs, percent).toPandas()
    assert len(got) == len(rows)
    linked = {int(i): int(c) for i, c in zip(got.doc_id, got.component_id) if i != c}
    lost = len(set(pairs.items()) - set(linked.items()))
    assert (lost, len(set(linked.items()) - set(pairs.items()))) == (0, 0)


def test_near_leaves_only_by_confirmed_links(spark, monkeypatch):
    """Sketches of a crowd at 0.79 often agree by chance: nobody may leave with a pivot that is not linked."""
    monkeypatch.setattr(near_dedup, "NEARLY_EQUAL", 46)  # most members are as near as this to some pivot
    monkeypatch.setattr(near_dedup, "LEAF", 32)
    check_crowd(spark, *crowd_below(600, 150, 13, 12))


def test_near_pairs_in_a_crowd_below(spark):
    """Pairs at 0.86 in a crowd at 0.79 that is larger than a leaf are all found."""
    check_crowd(spark, *crowd_below(2400, 1000, 13, 5))


def test_near_pairs_in_a_branching_crowd(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 64)
    check_crowd(spark, *crowd_below(1200, 500, 13, 5))


def test_components_of_paths_and_stars(spark):
    import random
    from apptflow.llm.components import connected
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


CHAT = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s>[INST]x[/INST]</s>"), (1, 2, "user", r"<\s>\[INST] \\ [\\/INST]"),
        (1, 3, "assistant", ""), (2, 0, "assistant", None), (3, None, None, None), (3, 0, "</s>[INST]", "a\nb"),
        (4, 5, "user", "tie"), (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"), (None, 0, "assistant", "é你"),
        (5, 0, "user", "no reply"), (6, 0, "assistant", "l" * 50_000), (6, 1, "user", "<"), (6, 2, "assistant", "/s>")]


def test_chat_edges(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in CHAT],
                                 "conv_id long, turn long, role string, text string, formatted string, example int")
    got = chat.read_back(chat.format_examples(rows)).toPandas()
    con = duck("/root/testdata/sf0.001")
    con.execute("DROP VIEW conversations")
    con.register("conversations", rows.select("conv_id", "turn", "role", "text").toArrow())
    want = con.execute(q.SQL["op4_prefix_target_chat"]).df()
    assert canon(got) == canon(want[~(want.conv_id == -1).fillna(False).astype(bool)])
    assert chat.read_back(chat.format_examples(rows.filter("false"))).count() == 0


def test_chat_examples_hold_prefix_and_target(spark):
    rows = spark.createDataFrame([(*r,) for r in CHAT], "conv_id long, turn long, role string, text string")
    ex = [r for r in chat.format_examples(rows).orderBy("example").collect() if r["conv_id"] == 1]
    assert len(ex) == 2 and ex[1]["formatted"].startswith(ex[0]["formatted"])
    target = ex[0]["formatted"][ex[0]["loss_start"]:ex[0]["loss_start"] + ex[0]["loss_length"]]
    assert target == r"<\s>[\INST]x[\/INST]<\/s>"


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (20, [0.5, -1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, [None, 1.0]), (6, None), (None, [1.0, 1.0]), (7, []), (40, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]),
            (9, [1.0, 0.5]), (9, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5120), (0, 2, 2, 5120), (0, 3, 9, 5120), (20, 1, 0, 0), (20, 2, 1, 0), (20, 3, 2, 0)]
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 20 == 0, 3).count() == 0


def test_top_k_of_large_components(spark):
    """Scores beyond 2**53, beyond 2**62 and beyond a long, which count as the largest or smallest long."""
    for big in (1e5, 1e8, 1e15, 1e30):
        rows = [(0, [1.0, big]), (1, [big, 1.0]), (2, [big, big]), (3, [-big, -big]), (4, [0.0, 0.0]), (5, [1e-3, 2.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = [tuple(r)[1:] for r in topk.top_k(df, F.col("vec_id") == 0, 4).orderBy("rank").collect()]
        largest = (1 << 63) - 1
        v = {i: [max(-largest - 1, min(largest, int(64 * x // 1))) for x in e] for i, e in rows}
        scores = {i: max(-largest, min(largest, sum(x * y for x, y in zip(v[0], v[i])))) for i in v if i}
        want = sorted((-s, i) for i, s in scores.items())[:4]
        assert got == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_top_k_refines(spark, monkeypatch):
    """Few bins, small blocks and many ties give the same as sorting."""
    import random
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.3, 1.0]) for _ in range(5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BINS", 5)
    monkeypatch.setattr(topk, "BLOCK", 7)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 9).collect())
    v = {i: [int((64 * x) // 1) if x != 0.3 else 19 for x in e] for i, e in rows}
    want = []
    for a in range(0, 400, 20):
        best = sorted((-sum(x * y for x, y in zip(v[a], v[b])), b) for b in v if b != a)[:9]
        want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    assert got == sorted(want)


PAGES = [(1, "http://a/\r\nX: y", "<html>one</html>"), (2, None, "<html>one</html>"), (3, "http://b/é", None), (4, "", ""),
         (None, "http://c", "<html>one</html>"), (5, "http://d", "\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 300_000),
         (2, None, "<html>one</html>")]


def test_warc_edges(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(pages, folder)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"])
                  for r in warc.read_archives(archives).collect()))
    assert got == [(-1, 16, "revisit", 2), (1, 16, "revisit", 2), (2, 16, "response", None), (2, 16, "response", None),
                   (3, 0, "revisit", 4), (4, 0, "response", None), (5, 14, "response", None), (6, 300_000, "response", None)]
    plain = warc.write_archives(pages, f"file://{tmp_path}/x", least_revisit_bytes=17)
    assert all(r["record_type"] == "response" for r in warc.read_archives(plain).collect())
    none = warc.write_archives(pages.filter("false"), f"file://{tmp_path}/y")
    assert warc.read_archives(none).count() == 0


def test_warc_long_first_record(tmp_path, monkeypatch):
    """One very long record at the head of an archive does not cost it its dictionary."""
    import struct
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 1 << 16)
    out = warc.ArchiveWriter(str(tmp_path), 0, 0)
    for i in range(50):
        html = f"<html><body class='page'>{'common boilerplate of a site ' * (9 if i else 9000)}{i * i}</body></html>"
        out.add(warc.page_record(i, f"http://x/{i}", html.encode(), None, "1970-01-01T00:00:00Z"))
    out.close()
    raw = open(out.done[0][0], "rb").read()
    assert struct.unpack("<I", raw[:4])[0] == warc.SKIPPABLE_MAGIC
    assert warc.train_dictionary([b"x" * 5000] * 7) is None


def test_warc_dictionary_and_frames(spark, sf_small, tmp_path):
    """The leading frame holds the dictionary, every record is a frame of its own, and archives roll over."""
    import struct
    import zstandard
    html = [(f"<html><body class='page'>{'common boilerplate of a site ' * 5}{i} {i * i}</body></html>").encode() for i in range(400)]
    out = warc.ArchiveWriter(str(tmp_path), 0, 0)
    for i, h in enumerate(html):
        out.add(warc.page_record(i, f"http://x/{i}", h, None, "1970-01-01T00:00:00Z"))
    out.close()
    raw = open(out.done[0][0], "rb").read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == warc.SKIPPABLE_MAGIC and size > 0
    words = zstandard.ZstdCompressionDict(raw[8:8 + size])
    assert words.dict_id() != 0
    frames, rest = 0, raw[8 + size:]
    while rest:
        d = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        assert d.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, frames = d.unused_data, frames + 1
    assert frames == len(html) + 1


def test_a_link_with_a_member_that_left_is_kept(spark, monkeypatch):
    """x agrees with y, which leaves the node with a pivot that x does not agree with."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "WHOLE", 1)
    least, n = 52, 60
    sketch = {i: [0] * 64 for i in range(n)}
    y, x = n, n + 1
    sketch[y] = [1] * 6 + [0] * 58
    sketch[x] = [1] * 6 + [2] * 12 + [0] * 46
    sets = spark.createDataFrame([(i, [7], s) for i, s in sketch.items()], "id long, roots array<int>, sketch array<short>")

    def confirm(clusters):
        rows = {}
        for r in clusters.collect():
            rows.setdefault(r["cluster"], set()).add(r["id"])
        out = [(a, min(ids)) for ids in rows.values() for a in ids
               if a != min(ids) and sum(p == q for p, q in zip(sketch[a], sketch[min(ids)])) >= least]
        return spark.createDataFrame(out, "a long, b long")

    clusters, known = near_dedup.candidate_clusters(sets, least, confirm)
    assert y in {r["a"] for more in known for r in more.collect()}  # it left
    rows = {}
    for r in clusters.collect():
        rows.setdefault(r["cluster"], set()).add(r["id"])
    assert any({x, y} <= ids for ids in rows.values())
