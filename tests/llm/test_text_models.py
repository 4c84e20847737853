"""Packing, tokens, classifiers and the pipeline against brute force, round trips and held-out accuracy."""
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apptflow.llm import lattice, packing, quality, toxicity
from apptflow.llm import queries as q
from tests_llm_edges import EDGES, edge_docs

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def check_packing(spark, docs, capacity=packing.CAPACITY):
    tok = tokenizers.Tokenizer.from_file(WORDS)
    packed = packing.pack_documents(docs, WORDS, capacity=capacity, with_ids=True)
    got = packed.toPandas()
    want = sorted(np.asarray([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
                  for r in docs.select("text").collect())
    got["doc"] = got.doc_id.fillna(-1)
    if not docs.filter("doc_id IS NULL").count() and docs.select("doc_id").distinct().count() == docs.count():
        whole = [b"".join(bytes(x) for x in g.sort_values("start").ids) for _, g in got.groupby("doc")]
        assert sorted(whole) == want
    assert int(got.length.sum()) == sum(len(w) // 4 for w in want)
    assert all(zlib.crc32(bytes(i)) == c and len(i) == 4 * n for i, c, n in zip(got.ids, got.ids_crc32, got.length))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= capacity
    rows = packing.sequences(packed, capacity).collect()
    assert len(rows) == got.sequence_id.nunique() and all(len(r["ids"]) == 4 * capacity for r in rows)
    return got


def test_packing_small(spark, sf_small):
    got = check_packing(spark, spark.read.parquet(f"{sf_small}/documents.parquet"))
    n = got.sequence_id.nunique()
    assert n == -(-int(got.length.sum()) // packing.CAPACITY) or got.length.sum() / (n * packing.CAPACITY) > 0.98


#: letters that the normaliser takes apart before a mark, combining marks after small and capital letters, special
#: tokens in either case, white space that does not split, words too long to keep
HARD_TEXTS = ["İ!!", "Aİ.", "x İ, y", "\u0958.", "\ufb2a!", "J\u030c, j\u030c", "T\u0308!", "ΟΔΟΣ. Σ, ς", "<|endoftext|> a",
              "<|ENDOFTEXT|>.", "a<|endoftext|>b|", "don't DON'T.", "a\x1cb\x85c\u3000d", "Über, über.", "w" * 99 + "!!",
              "é" * 70 + ".", "", " ", "\n\t", "3.14,15", "a..b", "你好。你好!", "!!!", "ﬁn.", "ſ."]


def test_word_ids(monkeypatch):
    """Texts one by one and together, small groups and a small cache, against the library."""
    import random
    tok = tokenizers.Tokenizer.from_file(WORDS)
    rnd = random.Random(6)
    alphabet = "aAbBIJTWyK'.,;:!?|<>  \n\t019-éüßÀİıΣςЖकĀ你\u0307\u030c\u0308\u0958\ufb2a\ufb01\x1c\u200b_"
    texts = HARD_TEXTS + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 25))) for _ in range(3000)]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "CACHE_WORDS", 500)
    for size in (1, 60, packing.GROUP_BYTES):
        monkeypatch.setattr(packing, "GROUP_BYTES", size)
        got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(WORDS)([t.encode() for t in texts])]
        assert got == want


def test_word_cache_memory():
    """What an encoder keeps between tasks stays beside the executor's heap, whatever the number of words."""
    encode = packing.WordEncoder(WORDS)
    tracemalloc.start()
    try:
        for at in range(0, 500_000, 25_000):
            words = [np.base_repr(i * 7919, 26).translate({ord(str(d)): 85 + d for d in range(10)}) for i in range(at, at + 25_000)]
            list(encode([" ".join(words).encode()]))
        assert tracemalloc.get_traced_memory()[0] < 50e6
    finally:
        tracemalloc.stop()


def test_texts_of_a_batch_in_parts():
    """A batch's texts are Python strings a part at a time; all get their score, in order."""
    class Sizes:
        def scorer(self):
            return lambda text: float(len(text or ""))

    rows = [None, "", *("x" * (10_000 + i) for i in range(3000))]
    batch = pa.array(rows)
    tracemalloc.start()
    try:
        got = [x for b in toxicity._scores(Sizes())(iter([batch, batch.slice(0, 0)])) for x in b.to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 10e6
    finally:
        tracemalloc.stop()
    assert got == [len(x or "") for x in rows]


def test_packing_hard_texts(spark):
    rows = [(i, t) for i, t in enumerate(HARD_TEXTS + [t for _, t in EDGES])]
    check_packing(spark, edge_docs(spark, rows), capacity=16)


def test_packing_hot_length(spark):
    """All pieces of one length: ranks from several partitions, every sequence full."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the end of it").alias("text"))
    got = check_packing(spark, docs.repartition(7), capacity=50)
    assert got.groupby("sequence_id").length.sum().eq(50).all()


def test_packing_edges(spark):
    check_packing(spark, edge_docs(spark), capacity=16)
    assert packing.pack_documents(edge_docs(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_place_every_length_once(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 30), rng.integers(1, 50, 30))}
    found = packing.patterns(histogram, 64)
    placed = {}
    for pattern, packs in found:
        assert sum(n * t for n, t in pattern) <= 64
        for n, t in pattern:
            placed[n] = placed.get(n, 0) + t * packs
    assert placed == histogram
    places = packing.Places(found)
    length = np.concatenate([np.full(c, n) for n, c in histogram.items()])
    rank = np.concatenate([np.arange(c) for c in histogram.values()])
    seq, off = places(length, rank)
    taken = {(s, o + i) for s, o, n in zip(seq, off, length) for i in range(n)}
    assert len(taken) == length.sum() and off.max() + 1 <= 64


def test_sentencepiece_edges(spark):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = lattice.load_pieces(path)
    more = ["a   b  \n\n c", "▁▁x", " lead", "supercalifragilistic" * 9, "\x00\x01²½", "tail  ", "  ", "▁", "a▁ ▁b", "x" * 62, "y" * 63]
    docs = edge_docs(spark, EDGES + [(11 + i, t) for i, t in enumerate(more)])
    got = lattice.encode(docs, pieces).withColumn("back", lattice.decoded(F.col("ids"), pieces)).collect()
    want = [(r["doc_id"], tuple(sp.encode(r["text"] or "")), (r["text"] or "").replace("▁", " ")) for r in docs.collect()]
    have = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["back"]) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert lattice.encode(edge_docs(spark, []), pieces).count() == 0


def test_sentencepiece_random_texts(spark, monkeypatch):
    """Units, blanks and unknown characters at random against the library, in several places and spans."""
    monkeypatch.setattr(lattice, "PLACE_ROWS", 37)
    monkeypatch.setattr(lattice, "SPAN_PLACES", 4)
    import random
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(11)
    words = ["the", "Haus", "été", "你好", "▁", "x1y2", "...", "international", "\n", "ab" * 40, "😀", "don't"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in lattice.encode(docs, lattice.load_pieces(path)).collect()}
    assert all(got[i] == sp.encode(t) for i, t in enumerate(texts))


def test_sentencepiece_units():
    """Units of texts cut at once against a pattern, with bytes that are no UTF-8."""
    import random
    import regex
    rnd = random.Random(5)
    parts = [" ", "  ", "▁", "a", "Bc", "é", "ß", "你好", "😀", ".", "...", "\n", "1", "\x00", "٣", "ª"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))).encode() for _ in range(500)] + [b"a\xff b", b"\xed\xa0\x80c", b""]
    for parted, pattern in ((True, r" *(?:\p{L}+|[^\p{L} ]+)| +"), (False, " *[^ ]+| +")):
        for some in (texts, [b"a b", b"", b"", b" c."], [b""], []):
            units, ends = lattice.cut_units(some, parted)
            units = [u.decode() for u in units.to_pylist()]
            want = [regex.findall(pattern, " " + t.decode("utf-8", "replace").replace("▁", " ")) if t else [] for t in some]
            assert [units[i:j] for i, j in zip([0, *ends], ends)] == want


def test_sentencepiece_place_memory(tmp_path):
    """The units of a place, and finding them, take memory of about their own size."""
    import tracemalloc
    import pyarrow as pa
    import pyarrow.fs
    import pyarrow.parquet as pq
    n = 200_000
    (tmp_path / "span=0").mkdir()
    pq.write_table(pa.table({"mask": pa.array([1] * n, pa.int32()), "unit": [f"▁{i}" for i in range(n)],
                             "ids": [np.uint32(i).tobytes() for i in range(n)]}), tmp_path / "span=0" / "part.parquet")
    pa.default_memory_pool().release_unused()
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        found = list(lattice._place_ids(pyarrow.fs.LocalFileSystem(), str(tmp_path / "span=0"), 0))
        assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - held < 60 * n
    finally:
        tracemalloc.stop()
    ids, ends = lattice.ids_of([b"7 199999", b"", b"0"], True, *found)
    assert ids.to_pylist() == [np.uint32(i).tobytes() for i in (7, 199999, 0)] and ends.tolist() == [2, 2, 3]
    with pytest.raises(KeyError):
        lattice.ids_of([b"200000"], True, *found)


def test_sentencepiece_decoded_with_ids(spark):
    """Decoding in the task that makes the ids is decoding the ids, and takes no second Python worker."""
    pieces = lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    got = lattice.encode(edge_docs(spark, EDGES), pieces, decoded_as="text")
    assert got.columns == ["doc_id", "ids", "text"]
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    rows = got.withColumn("back", lattice.decoded(F.col("ids"), pieces)).collect()
    assert rows and all(r["text"] == r["back"] for r in rows)


def test_sentencepiece_query(spark, sf_small):
    import hashlib
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = q.QUERIES["op3_sentencepiece_lattice"](spark, sf_small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_unigram_viterbi(spark):
    """The fold finds the best path of all segmentations."""
    rows = [(p, 300 + i, s) for i, (p, s) in enumerate(
        [("▁", -2.0), ("a", -2.5), ("b", -2.2), ("c", -3.1), ("ab", -3.0), ("bc", -3.3), ("abc", -6.0), ("▁a", -3.7), ("ca", -4.1)])]
    pieces = lattice.Pieces(rows, 3, "unigram", [])
    units = spark.createDataFrame([("▁abc",), ("▁cab",), ("▁abcabcabc",), ("▁" + "abc" * 30,)], "unit string")
    score = {p: s for p, _, s in rows}

    def best(text):
        table = [(0.0, [])] + [(-1e9, [])] * len(text)
        for t in range(1, len(text) + 1):
            table[t] = max(((table[s][0] + score[text[s:t]], table[s][1] + [text[s:t]])
                            for s in range(t) if text[s:t] in score), key=lambda x: x[0])
        return table[-1][0]

    by_id = {i: p for p, i, _ in rows}
    found = lattice.fold(lattice.edges(units, pieces), pieces).collect()
    assert len(found) == units.count()
    for r in found:
        path = [by_id[i] for i in np.frombuffer(r["ids"], "<u4").tolist()]
        assert "".join(path) == r["unit"]
        assert sum(score[p] for p in path) == pytest.approx(best(r["unit"]))


def accuracy(spark, sf_dir, name, label):
    got = q.QUERIES[name](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    return (both.predicted == both[label]).mean(), (both[label] == both[label].mode()[0]).mean()




@pytest.mark.parametrize("name,label,least", [("op10_subword_quality", "quality", 0.97), ("op5_noisy_channel_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    ours, majority = accuracy(spark, "/root/testdata/sf0.01", name, label)
    assert ours >= least and ours > majority


def test_models_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (6, None, None), (None, 1, 1), (9, 1, 0), (9, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    for module, label, drop in ((quality, "quality", quality.keep_good), (toxicity, "toxic", toxicity.drop_toxic)):
        for known in (labels, labels.filter("false")):
            model = module.fit(docs, known, label, 4, 2)
            got = module.score(docs, model).toPandas()
            assert len(got) == len(EDGES) and got.score.between(0, 1).all()
            assert drop(docs, model).columns == docs.columns
        assert module.score(edge_docs(spark, []), model).count() == 0
        assert module.fit(edge_docs(spark, []), labels, label, 4, 2) is not None


def test_restoring_obfuscated_words(spark):
    words = ["the clown said that an idiot is worthless and the moron lost all the trash of the stupid town"] * 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
    r = toxicity.Restorer(toxicity.log_model(toxicity.count_grams(docs)))
    assert "idiot" in r.word("1d10t") and "idiot" in r.word("id!ot") and "clown" in r.word("cl0wn")
    assert "moron" in r.word("m0r0n,") and "stupid" in r.word("stuuuupid") and "trash" in r.word("tr@sh!!")
    assert "idiot" in r.word("i.d.i.o.t") and "clown" in r.spaced("you c l o w n there")
    assert r.word("the") == ["the"] and r.word("12345") == [] and r.word("%%%") == []
    read = toxicity.Reader(r.model)
    assert toxicity.bucket("idiot") * toxicity.KINDS in read("an 1D10T!!")


def restorer(spark):
    words = ["the clown said that an idiot is worthless and the moron lost all the trash of the stupid town, kick his ass"] * 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(words)], "doc_id long, text string")
    return toxicity.Restorer(toxicity.log_model(toxicity.count_grams(docs)))


def test_restoring_first_and_last_letters(spark):
    r = restorer(spark)
    assert "stupid" in r.word("$tupid") and "idiot" in r.word("!diot") and "clown" in r.word("(lown")
    assert "trash" in r.word("+rash") and "ass" in r.word("@$$") and "idiot" in r.word("\"!dio+\",")
    assert "trash" in r.word("trash!!") and "clown" in r.word("(clown)") and "worthless" in r.word("worthle$$")
    assert r.word("12345,") == [] and r.word("the,") == ["the"]


def test_restoring_letters_set_apart(spark):
    r = restorer(spark)
    for text in ("an i  d  i  o  t here", "i\nd\ni\no\nt", "i - d - i - o - t", "! d i o t", "you 1, d, 1, 0, t,"):
        assert "idiot" in r.spaced(text), text
    assert "moron" in r.spaced("m, o, r, o, n") and "stupid" in r.spaced("s t u p ! d")
    assert "stupid" in r.spaced("$ t u p i d") and "clown" in r.spaced("you c l o w n there")
    assert r.spaced("the clown said, an idiot") == []


def test_pipeline_small(spark):
    """Every stage's decisions take effect, and copies, bad and toxic documents are gone at the end."""
    import corpus_pipeline as p
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps, kept = [docs], docs
    for name, stage in p.STAGES[:-1]:
        kept = p.stored(stage(spark, kept, sf), f"test-{name}")
        assert kept.columns == docs.columns
        steps.append(kept)
    counts = [s.count() for s in steps]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = lambda d: d.join(labels.filter("toxic = 1"), "doc_id").count()
    clean = lambda d: d.join(labels.filter("toxic = 0"), "doc_id").count()
    assert toxic(steps[1]) <= 0.25 * toxic(docs) and clean(steps[1]) >= 0.97 * clean(docs)
    bad = labels.filter("quality = 0")
    assert steps[2].join(bad, "doc_id").count() <= 0.1 * steps[1].join(bad, "doc_id").count()
    norm = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")
    assert steps[3].select(norm).distinct().count() == steps[3].count() == steps[2].select(norm).distinct().count()
    last = p.STAGES[-1][1](spark, kept, sf)
    assert last.select("doc_id").distinct().count() == counts[-1]
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]


def plain_slots(text):
    """Buckets of a text's words, n-grams and repeats, one after the other in Python integers."""
    def mixed(h):
        h &= 0xFFFFFFFF
        return ((h ^ h >> 15) * quality.MIX & 0xFFFFFFFF) >> 16

    data = text.encode()
    if not data.strip():
        return []
    padded = b" " + data + b" "
    slots = [mixed(sum(c * m for c, m in zip(padded[i:i + n], quality.MULTIPLIERS)) + n)
             for n in (3, 4) for i in range(len(padded) - n + 1)]
    words = [sum((c + 1) * (i * quality.MULTIPLIERS[0] + 1) for i, c in enumerate(w)) & 0xFFFFFFFF for w in data.split()]
    slots += [mixed(h) for h in words]
    return slots + [int(quality.REPEAT_SLOT) + 2 * k + (words[i] == words[i - k])
                    for k in quality.REPEATS for i in range(k, len(words))]


def test_quality_score_is_softmax_of_averaged_vectors(monkeypatch):
    """The one number a bucket gives what averaging all vectors and the softmax layer give, also across slices."""
    rng = np.random.default_rng(3)
    vectors, layer, bias = rng.normal(0, 3, (quality.BUCKETS, quality.DIM)), rng.normal(0, 1, (quality.DIM, 2)), rng.normal(0, 1, 2)
    model = quality.Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))
    texts = ["", "  ", "a", "one two two one two", "été 你好 x", "the cat sat on the the mat " * 40]
    for cut in (quality.SLICE, 16):
        monkeypatch.setattr(quality, "SLICE", cut)
        for text in texts:
            slots = plain_slots(text)
            assert sorted(np.concatenate([[], *quality.hashed(text)]).astype(int).tolist()) == sorted(slots)
            z = (vectors[slots].mean(0) if slots else np.zeros(quality.DIM)) @ layer + bias
            p = np.exp(z - z.max())
            assert model(text) == pytest.approx(p[1] / p.sum(), abs=1e-5)


def test_decoding_is_the_best_of_all_lattice_paths(spark):
    """Viterbi against every path of the lattice, scored letter by letter, on spans of letters, symbols and runs."""
    import itertools
    import random
    r, rnd = restorer(spark), random.Random(5)
    spans = ["1d10t", "stuuupid", "a$$", "$$$", "i.d.i.0.t", "+r@sh!!"]
    spans += ["".join(rnd.choice("aistd01!$@+.-") * rnd.choice((1, 1, 2, 3)) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    for span in spans:
        scored = {}
        for path in itertools.product(*r.lattice(span), [(" ", 0.0)]):
            text, total, state = "".join(t for t, _ in path), sum(c for _, c in path), [0] * (toxicity.ORDER - 1)
            for x in toxicity.letters(text):
                gram = [*state, x]
                total += r.model[np.ravel_multi_index(gram, (toxicity.LETTERS,) * toxicity.ORDER)]
                state = gram[1:]
            scored[text] = max(scored.get(text, -np.inf), total)
        assert scored[r.decode(span)] == pytest.approx(max(scored.values()), abs=1e-4), span
