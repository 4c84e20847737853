"""The queries of this subpackage and their DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apptflow.llm import (chat, exact_dedup, hilbert_shards, labelled, lattice, mixing, near_dedup, packing,
                          prefix_trie, quality, resampling, topk, toxicity, warc)
from apptflow.llm.common import read, scratch_path

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


N_SHARDS = 40
SHARD_DIMS = ["lang", "source"]


def _hilbert_sql(bits: int) -> str:
    """The curve's index of cells x0, x1, x2 as a chain of selects."""
    out, last = [], "cells"
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(3):
            t = f"(xor(x0, x{i}) & {p})"
            new = [f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {t}) END AS x0"]
            new += [f"CASE WHEN x{i} & {q} <> 0 THEN x{j} ELSE xor(x{j}, {t}) END AS x{j}" if j == i else f"x{j}"
                    for j in (1, 2)]
            name = f"turn_{level}_{i}"
            out.append(f"{name} AS (SELECT doc_id, size, text_crc32, {', '.join(new)} FROM {last})")
            last = name
    out.append(f"gray AS (SELECT doc_id, size, text_crc32, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM {last})")
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x2 & {1 << level} <> 0 THEN {(1 << level) - 1} ELSE 0 END)"
    out.append(f"flip AS (SELECT doc_id, size, text_crc32, x0, x1, x2, {flip} AS t FROM gray)")
    weave = " + ".join(f"(((xor(x{i}, t) >> {b}) & 1) << {3 * b + 2 - i})" for b in range(bits) for i in range(3))
    out.append(f"curve AS (SELECT doc_id, size, text_crc32, ({weave})::BIGINT AS curve_index FROM flip)")
    return ",\n".join(out)


SQL_SHARD = f"""
WITH RECURSIVE tab AS (
  SELECT n::UBIGINT AS n, n::UBIGINT AS c, 0 AS k FROM range(256) r(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crct AS (SELECT list(c ORDER BY n) AS t FROM tab WHERE k = 8),
base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT) AS bytes
  FROM documents),
cells AS (
  SELECT doc_id, size,
    xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INT + 1]), 4294967295::UBIGINT),
        4294967295::UBIGINT)::BIGINT AS text_crc32,
    ((rank() OVER (ORDER BY lang) - 1) * 32 // count(*) OVER ())::BIGINT AS x0,
    ((rank() OVER (ORDER BY source) - 1) * 32 // count(*) OVER ())::BIGINT AS x1,
    ((rank() OVER (ORDER BY size) - 1) * 32 // count(*) OVER ())::BIGINT AS x2
  FROM base, crct),
{_hilbert_sql(hilbert_shards.BITS)},
placed AS (
  SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY curve_index, doc_id NULLS FIRST, text_crc32, size) - 1 AS position FROM curve)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (position * {N_SHARDS} // n)::INT AS shard,
  (position - ((position * {N_SHARDS} // n) * n + {N_SHARDS - 1}) // {N_SHARDS})::BIGINT AS slot,
  NULL::INT AS grown_shard, curve_index
FROM placed
"""


@query("op1_hilbert_shards", SQL_SHARD)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hilbert_shards.hilbert_shards(read(spark, sf_dir, "documents"), SHARD_DIMS, N_SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "curve_index")


PLANTED_CHAT = "</s>[INST] ok [/INST]"

SQL_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(20 + length(role) + length(text)
      + len(regexp_extract_all(role, '<\\*/?s>')) + len(regexp_extract_all(role, '\[\\*/?INST\]'))
      + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*/?INST\]'))) OVER w AS upto
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op4_prefix_target_chat", SQL_CHAT)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_CHAT).alias("text"))
    return chat.read_back(chat.format_examples(said.unionByName(planted)))


SQL_EXACT = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW g AS (PARTITION BY norm)
"""


@query("op8_content_sort_dedup", SQL_EXACT)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


# base32 of a SHA-1 digest: eight groups of five hex digits, four letters each
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT + 1, 1)"
    for g in range(8) for k in range(4))

SQL_WARC = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM hashed
"""


@query("op2_warc_dictionary", SQL_WARC)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"), least_revisit_bytes=0)
    return warc.read_archives(archives)


TOP_K = 20

SQL_TOP_K = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {TOP_K}
"""


@query("op6_histogram_top_k", SQL_TOP_K)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, TOP_K)


@query("op9_shortest_pack_first")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


TOXIC_HELD_OUT = (4, 2)  # modulus and remainder of crc32 of the identifier
QUALITY_HELD_OUT = (5, 0)


@query("op5_noisy_channel_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), "toxic", *TOXIC_HELD_OUT)
    return toxicity.score(docs, model).select(
        "doc_id", labelled.held_out(F.col("doc_id"), *TOXIC_HELD_OUT).alias("held_out"), "score", "predicted")


@query("op10_subword_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), "quality", *QUALITY_HELD_OUT)
    return quality.score(docs, model).select(
        "doc_id", labelled.held_out(F.col("doc_id"), *QUALITY_HELD_OUT).alias("held_out"), "score", "predicted")


NEAR_PERCENT = 85

SQL_NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
  HAVING 100 * count(*) >= {NEAR_PERCENT} * ((SELECT n FROM sizes WHERE doc_id = x.doc_id)
    + (SELECT n FROM sizes WHERE doc_id = y.doc_id) - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reached r ON d.doc_id = r.a LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op7_chosen_path_near_dedup", SQL_NEAR)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), NEAR_PERCENT)


@query("op3_sentencepiece_lattice")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    pieces = lattice.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    coded = lattice.encode(read(spark, sf_dir, "documents"), pieces, is_table=True, decoded_as="text")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
                        F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


# crc32 of a text: table t of 256 registers, folded over the text's bytes
_CRC_TABLE = """crc_steps AS (
  SELECT n::UBIGINT AS n, n::UBIGINT AS c, 0 AS k FROM range(256) r(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crct AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return (f"xor(list_reduce({data}, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INT + 1]), 4294967295::UBIGINT), "
            "4294967295::UBIGINT)::BIGINT")


SQL_TRIE = rf"""
WITH RECURSIVE {_CRC_TABLE},
said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT c, list(struct_pack(r := role, x := text) ORDER BY i) AS turns FROM said GROUP BY c),
headed AS (SELECT *, {_crc_sql('c::VARCHAR')} % 4 AS h FROM whole, crct),
rebuilt AS (
  SELECT a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns
  FROM headed a LEFT JOIN whole b ON b.c = a.c - a.c % 20),
prefixes AS (SELECT c, d, turns[1:d] AS p, len(turns) = d AS ends FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
nodes AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON n.d = k.d AND n.p = k.p),
below AS (
  SELECT v.d AS at, v.p[1:u.d] AS p, u.d, v.n_children = 0 AS leaf, (v.n_convs - 1) * v.words AS saved
  FROM full_nodes v, LATERAL (SELECT unnest(range(v.d + 1)) AS d) u),
sums AS (SELECT d, p, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved FROM below GROUP BY d, p)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  s.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON n.d = s.d AND n.p = s.p
LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""


@query("op11_conversation_prefix_trie", SQL_TRIE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_index")


DRAW_PERCENT = 25
DRAW_WORDS = 20
DRAW_SEED = 7

SQL_RESAMPLE = rf"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (
  SELECT 'raw' AS side, row_number() OVER () AS k, doc_id, text FROM documents
  UNION ALL SELECT 'target', row_number() OVER (), NULL, text FROM benchmark),
spoken AS (
  SELECT side, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
found AS (
  SELECT side, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM spoken),
counted AS (SELECT side, k, f, count(*) AS n FROM found GROUP BY side, k, f),
buckets AS (SELECT f, {_crc_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), crct),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'raw'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'target'), 0)::DOUBLE AS t
  FROM counted JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000)
    / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (
  SELECT k, sum(n) AS n_features, sum(n * gain) AS total
  FROM counted JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY k),
scored AS (
  SELECT doc_id, len(p.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS luck
  FROM spoken p LEFT JOIN weights USING (k) WHERE side = 'raw'),
ranked AS (
  SELECT *, weight + luck AS score, row_number() OVER (PARTITION BY n_words >= {DRAW_WORDS}
    ORDER BY weight + luck DESC, doc_id NULLS LAST, n_features, weight) AS place,
    (SELECT count(*) FROM scored WHERE n_words >= {DRAW_WORDS}) AS eligible FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= {DRAW_WORDS} AND place <= eligible * {DRAW_PERCENT} // 100 THEN place END AS rank
FROM ranked
"""


@query("op12_importance_resampling", SQL_RESAMPLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), DRAW_PERCENT,
                               DRAW_WORDS, DRAW_SEED)
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


MIX_WEIGHTS = [3, 1, 2]
MIX_PERCENT = 150
MIX_MOST = 2

SQL_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h,
    (length(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) + 1)::DOUBLE
      / (length(coalesce(text, '')) + 1)::DOUBLE AS quality FROM documents),
keyed AS (SELECT *, -ln((h::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE) / quality AS key FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS w, {MIX_MOST} * source_size AS cap FROM sources),
before AS (
  SELECT *, coalesce(sum(cap) OVER r, 0) AS caps, coalesce(sum(w) OVER r, 0) AS ws FROM weighed
  WINDOW r AS (ORDER BY cap::DOUBLE / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT max(((SELECT sum(source_size) FROM sources)::DOUBLE * {MIX_PERCENT} / 100 - caps) / ((SELECT sum(w) FROM weighed) - ws)) AS l
  FROM before),
targets AS (SELECT source, source_size, least(cap::DOUBLE, l * w) AS target FROM weighed, level),
placed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target,
    CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size) ELSE 0 END::BIGINT AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""


@query("op13_weighted_mix", SQL_MIX)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_PERCENT, MIX_MOST)
    return rows.select("doc_id", "size", "source_size", "target", "taken")
