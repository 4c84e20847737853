"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units that no piece can span (white space starts a unit;
letters and other characters part where the piece table has no piece across).
Units are made distinct over the corpus; every unit is exploded into its
substrings of bounded length, these are equi-joined to the piece table (a
vocabulary, broadcast), the edges are grouped by unit and folded with Spark's
``aggregate``:

* ``unigram`` models: Viterbi, the path with the highest sum of scores;
* ``bpe`` models, whose encoding is not the path of the highest sum: the edges
  in the order of their scores, leftmost first, each joined where it covers
  exactly two neighbouring symbols, which is the order the merges are made in.

An edge is one long: the piece's rank by score, start and length. A unit's
boundaries are a bit mask in a long. Units of more than ``MASK``
characters, for which a long has no bits, are looked up and folded in a task,
with a heap.

A character without a piece becomes the pieces of its UTF-8 bytes.

The units' ids go back to the texts by place: a run of ``PLACE_ROWS`` rows of a
table's file. ``SPAN_PLACES`` places, a span, share a dictionary in a shared folder,
where a unit is one row with a mask of the places that hold it; the task that reads
a place's rows keeps the units of that place. So the texts themselves are never
shuffled. Within a task, texts are cut into units, and units are made distinct and looked up,
a few megabytes of text at a time and in Arrow buffers: no unit is a Python object.

Defined results: null and empty texts have no ids and decode to the empty text.
A blank and U+2581 encode alike, and decode as blanks. Null identifiers and
repeated rows are encoded like any other. An empty table gives no rows.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import let, partitions, scratch_path, stored
from apptflow.llm.warc import file_system

BLANK = "▁"
MASK = 62
PLACE_ROWS = 4096
#: places that share a dictionary, at most the bits of an int, and the size of its row groups
SPAN_PLACES = 16
ROW_GROUP_BYTES = 4 << 20
#: units, distinct in what is cut at once, that a task collects from the places of a span before it hands them on
FLUSH_UNITS = 1_500_000
#: units of a batch that a task hands on
BATCH_UNITS = 1 << 16
#: bytes of text taken apart at once
TEXT_BYTES = 1 << 20
#: tasks that take units apart, for each partition of other shuffles
UNIT_TASKS = 4
#: units whose edges a task lists in memory, about a kilobyte each, before it sorts them
LISTS_IN_MEMORY = 150_000
#: bits of a rank in a code
CODE_BITS = 29
#: rank of a character without a piece; fields of an edge: rank, 29 bits of start, 5 bits of length
UNKNOWN = 1 << 28
RANK, START, LENGTH = "shiftright(e, 34)", "CAST(shiftright(e, 5) & 536870911L AS INT)", "CAST(e & 31L AS INT)"


@dataclass
class Pieces:
    """A piece table: rows (piece, id, score), the byte pieces' ids, and what pieces span."""
    rows: list[tuple[str, int, float]]
    bytes_first: int
    kind: str
    texts: list[bytes]

    def __post_init__(self) -> None:
        self.rows = sorted(self.rows, key=lambda r: (-r[2], r[1]))  # a row's place is its rank

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @property
    def parted(self) -> bool:
        """Whether letters and other characters are units of their own."""
        def mixed(p: str) -> bool:
            rest = p.lstrip(BLANK)
            return BLANK in rest or len({int(_kinds()[ord(c)]) for c in rest}) > 1
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in self.rows):
            raise ValueError("pieces with inner blanks are not supported")
        return not any(mixed(p) for p, _, _ in self.rows)


def load_pieces(model_file: str) -> Pieces:
    """The piece table of a SentencePiece model with byte pieces and no normalisation."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    with open(model_file, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("only models with a dummy prefix and no normalisation are supported")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rows, texts = [], []
    for i in range(sp.vocab_size()):
        special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        if sp.is_byte(i):
            texts.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
        elif special:
            texts.append(b"")
        else:
            rows.append((sp.id_to_piece(i), i, sp.get_score(i)))
            texts.append(sp.id_to_piece(i).replace(BLANK, " ").encode())
    return Pieces(rows, sp.piece_to_id("<0x00>"), "bpe" if model.trainer_spec.model_type == 2 else "unigram", texts)


def edges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, chars, edges by rank and start: the substrings of the units that are pieces.

    A unit is exploded into its starts; a start keeps the lengths up to the longest piece that begins with its first two
    characters, which are exploded and joined to the pieces. Both tables are a vocabulary, broadcast. Merges need no edges of
    one character, so ``bpe`` units have only one, which keeps units without longer ones. ``units`` (unit) is partitioned
    by ``unit`` and stays so: neither the explosions nor the broadcasts move rows. Units over ``MASK`` are not taken apart.
    """
    spark = units.sparkSession
    table = spark.createDataFrame([(p, rank) for rank, (p, _, _) in enumerate(pieces.rows)], "piece string, rank long")
    reach: dict[str, int] = {}
    for p, _, _ in pieces.rows:
        if len(p) > 1:
            reach[p[:2]] = max(reach.get(p[:2], 0), len(p))
    begins = spark.createDataFrame(list(reach.items()), "begin string, reach int")
    least = "1" if pieces.kind == "unigram" else "IF(start = 0, 1, 2)"
    d = units.withColumn("chars", F.char_length("unit"))
    d = d.select("unit", "chars", F.explode(F.expr(f"IF(chars > {MASK}, array(0), sequence(0, chars - 1))")).alias("start"))
    d = d.join(F.broadcast(begins), F.expr("substring(unit, start + 1, 2)") == F.col("begin"), "left")
    d = d.withColumn("most", F.expr(f"IF(chars > {MASK}, 1, least(coalesce(reach, 1), chars - start))"))
    d = d.filter(F.expr(f"most >= {least}"))
    d = d.select("unit", "chars", "start", F.explode(F.expr(f"sequence({least}, most)")).alias("length"))
    d = d.join(F.broadcast(table), F.expr("substring(unit, start + 1, length)") == F.col("piece"), "left")
    d = d.filter(F.col("rank").isNotNull() | (F.col("length") == 1))
    edge = F.shiftleft(F.coalesce("rank", F.lit(UNKNOWN).cast("long")), 34).bitwiseOR(
        F.shiftleft(F.col("start").cast("long"), 5)).bitwiseOR(F.col("length").cast("long"))
    return d.groupBy("unit", "chars").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


_ENDS = f"(shiftleft(1L, {START}) | shiftleft(1L, {START} + {LENGTH}))"


def _merged() -> str:
    """Fold of the edges in merge order: mask of the boundaries that are left. Bit i: before character i."""
    inner = f"(shiftleft(1L, {START} + {LENGTH}) - shiftleft(1L, {START} + 1))"
    return (f"aggregate(edges, shiftleft(1L, chars + 1) - 1, (m, e) -> CASE WHEN {LENGTH} > 1 "
            f"AND m & {_ENDS} = {_ENDS} AND bit_count(m & {inner}) = 1 THEN m & ~{inner} ELSE m END)")


def _viterbi(scores: list[float]) -> str:
    """Fold of the edges by their ends: best score and last edge of every prefix, then the boundaries back from the end."""
    table = f"array({', '.join(f'{x!r}D' for x in scores)})"
    score = f"IF({RANK} = {UNKNOWN}, {min(scores) - 10!r}D, element_at({table}, CAST({RANK} AS INT) + 1))"
    by_end = f"transform(sort_array(transform(edges, e -> struct({START} + {LENGTH} AS last, e AS e))), x -> x.e)"
    start = ("transform(sequence(0, chars), i -> named_struct('score', "
             "IF(i = 0, CAST(0 AS DOUBLE), CAST('-Infinity' AS DOUBLE)), 'back', 0))")
    step = (f"(b, e) -> IF(b[{START}].score + {score} > b[{START} + {LENGTH}].score, transform(b, (x, i) -> "
            f"IF(i = {START} + {LENGTH}, named_struct('score', b[{START}].score + {score}, 'back', {START}), x)), b)")
    best = f"aggregate({by_end}, {start}, {step})"
    walk = ("aggregate(sequence(1, chars), named_struct('at', chars, 'm', "
            "shiftleft(1L, chars)), (w, i) -> IF(w.at = 0, w, named_struct('at', b[w.at].back, 'm', "
            "w.m | shiftleft(1L, b[w.at].back))), w -> w.m)")
    return let(best, "b", walk)


def long_edges(unit: str, ranks: dict[str, int], longest: int) -> dict[tuple[int, int], int]:
    """Rank of each (start, length) of a unit of any length."""
    found = {(i, 1): ranks.get(c, UNKNOWN) for i, c in enumerate(unit)}
    for k in range(2, longest + 1):
        for i in range(len(unit) - k + 1):
            if (rank := ranks.get(unit[i:i + k])) is not None:
                found[i, k] = rank
    return found


def merge_long(n: int, ranks: dict[tuple[int, int], int]) -> list[int]:
    """The merge fold for a unit of any length: its longer pieces, as ``fold`` codes them."""
    nxt, prv, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (i, size[i] + size[j]) in ranks:
            heapq.heappush(heap, (ranks[i, size[i] + size[j]], i, size[i], size[j]))

    heap: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if size[i] != a or a == 0 or j >= n or size[j] != b:
            continue
        size[i], size[j] = a + b, 0
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [i << CODE_BITS | ranks[i, size[i]] for i in range(n) if size[i] > 1]


def viterbi_long(n: int, ranks: dict[tuple[int, int], int], scores: list[float]) -> list[int]:
    """The Viterbi fold for a unit of any length: its longer pieces, as ``fold`` codes them."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-np.inf, 0, 0)] * n
    for (start, length), rank in sorted(ranks.items(), key=lambda x: sum(x[0])):
        score = best[start][0] + (min(scores) - 10 if rank == UNKNOWN else scores[rank])
        if score > best[start + length][0]:
            best[start + length] = (score, start, rank)
    out, at = [], n
    while at:
        _, start, rank = best[at]
        if at - start > 1:
            out.append(start << CODE_BITS | rank)
        at = start
    return out[::-1]


def fold(lattice: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, ids (little-endian unsigned 32-bit) of the units of ``edges``.

    The fold leaves a mask of boundaries; the edges between two of them are the unit's pieces. Those of more than one
    character come out as longs, start and rank; ids are put together from them and the characters between.
    """
    scores = [s for _, _, s in pieces.rows]
    merged = _merged() if pieces.kind == "bpe" else _viterbi(scores)
    outer = f"(shiftleft(1L, {START} + {LENGTH} + 1) - shiftleft(1L, {START}))"
    # the mask is bound by ``let``: as a column it would be put into the filter's lambda and made anew for every edge
    kept = let(merged, "mask", f"sort_array(transform(filter(edges, e -> {LENGTH} > 1 AND mask & {outer} = {_ENDS}), "
               f"e -> shiftleft(CAST({START} AS BIGINT), {CODE_BITS}) | {RANK}))")
    codes = F.when(F.col("chars") <= MASK, F.expr(kept))
    rows, kind, longest, first_byte = pieces.rows, pieces.kind, pieces.longest, pieces.bytes_first

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_bytes = [int(i).to_bytes(4, "little") for _, i, _ in rows]
        sizes, ranks = [len(p) for p, _, _ in rows], {p: rank for rank, (p, _, _) in enumerate(rows)}
        chars = {p: id_bytes[rank] for p, rank in ranks.items() if len(p) == 1}

        def char(c: str) -> bytes:
            """A character without a piece becomes the pieces of its UTF-8 bytes."""
            if c not in chars:
                chars[c] = b"".join([(first_byte + x).to_bytes(4, "little") for x in c.encode("utf-8", "replace")])
            return chars[c]

        for batch in batches:
            out = []
            for unit, found in zip(batch.column("unit").to_pylist(), batch.column("codes").to_pylist()):
                if found is None:
                    every = long_edges(unit, ranks, longest)
                    found = merge_long(len(unit), every) if kind == "bpe" else sorted(viterbi_long(
                        len(unit), every, [s for _, _, s in rows]))
                parts, at = [], 0
                for code in found:
                    start, rank = code >> CODE_BITS, code & ((1 << CODE_BITS) - 1)
                    parts += [char(c) for c in unit[at:start]]
                    parts.append(id_bytes[rank])
                    at = start + sizes[rank]
                parts += [char(c) for c in unit[at:]]
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(out, pa.binary())], names=["unit", "ids"])

    return lattice.select("unit", codes.alias("codes")).mapInArrow(to_ids, "unit string, ids binary")


def dictionary(places: DataFrame, pieces: Pieces) -> str:
    """Ids of the units of every span (span, mask of places, unit), as files in the shared folder, a folder for each."""
    spark = places.sparkSession
    d = places.filter("unit IS NOT NULL")  # so that the join adds no filter below one of the exchanges
    # the edges of a task's units are held at once: more and smaller tasks than those of other shuffles
    d = d.repartition(UNIT_TASKS * partitions(spark), "unit")
    # both readers take all columns, so that they share one exchange
    distinct = (d.groupBy("unit").agg(F.bit_or("mask").alias("any_mask"), F.min("span").alias("any_span"))
                .filter("any_mask IS NOT NULL AND any_span IS NOT NULL").select("unit"))
    by_span = d.groupBy("unit", "span").agg(F.bit_or("mask").alias("mask"))
    ids = fold(edges(distinct, pieces), pieces)
    path = scratch_path(spark, "units")
    # rows of a unit come one after the other: lists of so many units are kept in memory before rows are sorted by unit
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(LISTS_IN_MEMORY))
    try:
        # units in their order begin alike, which compresses
        (by_span.join(ids, "unit").repartition("span").sortWithinPartitions("span", "unit")
         .select("span", "mask", "unit", "ids").write.option("parquet.block.size", ROW_GROUP_BYTES)
         .option("compression", "zstd").partitionBy("span").parquet(path))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return path


@cache
def _kinds() -> np.ndarray:
    """Kind of every code point: a blank (2), a letter (1) or another (0)."""
    kinds = np.zeros(0x110000, np.uint8)
    for letters in regex.finditer(r"\p{L}+", "".join(map(chr, range(len(kinds))))):
        kinds[letters.start():letters.end()] = 1
    kinds[32] = 2
    return kinds


def _offsets(array: pa.LargeBinaryArray) -> np.ndarray:
    """Where the values of an array begin in its bytes, and where the last one ends."""
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]


def cut_units(texts: list[bytes], parted: bool) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The units of the texts, one text after the other, with blanks for ``BLANK``, and where each text's units end.

    Every text that is not empty gets a blank before it. A unit is a run of blanks with the run of letters or of other
    characters after it, if any; if not ``parted``, with all up to the next blank.
    """
    texts = [t.replace(BLANK.encode(), b" ") if b"\xe2\x96\x81" in t else t for t in texts]
    shown = b"".join([b" " + t for t in texts if t])
    if not shown:
        return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(shown, np.uint8)
    kinds = _kinds()[raw]
    if not shown.isascii():
        try:
            points = np.frombuffer(shown.decode().encode("utf-32-le"), "<u4")
        except UnicodeDecodeError:
            return cut_units([t.decode("utf-8", "replace").encode() for t in texts], parted)
        kinds[raw >= 0xC0] = _kinds()[points[points >= 0x80]]
        del points
    if not parted:
        kinds[kinds == 1] = 0
    lead = raw & 0xC0 != 0x80  # the first byte of a character
    kinds = kinds[lead]
    begins = np.ones(len(raw), bool)
    begins[lead] = np.append(True, (kinds[1:] != kinds[:-1]) & (kinds[:-1] != 2))
    begins &= lead
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    text_ends = np.cumsum(sizes)
    begins[(text_ends - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(shown)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(shown)])
    return units, np.searchsorted(starts, text_ends)


def _rows_by_place(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """span, place and texts of each run of rows of one place, about ``TEXT_BYTES`` at a time."""
    places, spans = batch.column("place").to_numpy(), batch.column("span").to_numpy()
    texts = batch.column("text").cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    other = (places[1:] != places[:-1]) | (spans[1:] != spans[:-1])
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(places)]
    for i, j in zip(cuts, cuts[1:]):
        while i < j:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[i:j]), TEXT_BYTES, "right")))
            yield int(spans[i]), int(places[i]), [t or b"" for t in texts.slice(i, n).to_pylist()]
            i += n


def _place_units(docs: DataFrame, parted: bool) -> DataFrame:
    """span, unit, mask of places: a unit once or, where a task met many units, a few times for a span and task."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[pa.Array]] = {}  # by place
        at, n = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            tables = []
            for place in list(found):
                units = pc.unique(pa.concat_arrays(found.pop(place))).cast(pa.string())
                tables.append(pa.table({"unit": units, "mask": pa.array(np.full(len(units), 1 << place, np.int64))}))
            # a unit is there once for each place: the sum of its bits is their mask
            merged = pa.concat_tables(tables).group_by("unit", use_threads=False).aggregate([("mask", "sum")])
            del tables, units
            for part in merged.to_batches(BATCH_UNITS):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), at, np.int64)), pc.replace_substring(part.column("unit"), " ", BLANK),
                    part.column("mask_sum").cast(pa.int32())], names=["span", "unit", "mask"])

        for batch in batches:
            for span, place, texts in _rows_by_place(batch):
                if found and (span != at or n > FLUSH_UNITS):
                    yield from flush()
                    n = 0
                    pa.default_memory_pool().release_unused()
                at = span
                units = pc.unique(cut_units(texts, parted)[0])
                if len(units):
                    found.setdefault(place, []).append(units)
                    n += len(units)
        if found:
            yield from flush()
        pa.default_memory_pool().release_unused()

    return docs.select("span", "place", "text").mapInArrow(distinct, "span long, unit string, mask int")


def _with_place(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, span and the place in its span of every row of a table of files."""
    row, file = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    place = (F.floor(row / PLACE_ROWS) % SPAN_PLACES).cast("long")
    span = F.xxhash64(file, F.floor(row / (PLACE_ROWS * SPAN_PLACES)), F.lit("span"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), place.alias("place"), span.alias("span"))


def _place_ids(fs: pa.fs.FileSystem, folder: str, place: int) -> tuple[pa.Array, pa.Array]:
    """Units of a place, with blanks for ``BLANK``, and their ids, out of its span's dictionary, which is read in small
    batches."""
    bit = pa.scalar(1 << place, pa.int32())
    units, ids = [pa.array([], pa.large_binary())], [pa.array([], pa.large_binary())]
    for name in pa.parquet.ParquetDataset(folder, filesystem=fs, partitioning=None).files:
        with pa.parquet.ParquetFile(name, filesystem=fs) as file:
            for part in file.iter_batches(1 << 14, columns=["mask", "unit", "ids"], use_threads=False):
                part = part.filter(pc.equal(pc.bit_wise_and(part.column("mask"), bit), bit))
                units.append(pc.replace_substring(part.column("unit"), BLANK, " ").cast(pa.large_binary()))
                ids.append(part.column("ids").cast(pa.large_binary()))
    return pa.concat_arrays(units), pa.concat_arrays(ids)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text",
           is_table: bool = False, decoded_as: str | None = None) -> DataFrame:
    """id, ids (little-endian unsigned 32-bit) of every row; the text decoded from the ids, as a column of that name.

    ``decoded_as`` is ``decoded`` in the task that made the ids: a second Python worker for each task and batches of ids
    for ten thousand rows between the two are saved.

    ``is_table``: ``docs`` is read from files as it is, so that its rows have
    places; any other DataFrame is stored first.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    d = _with_place(docs if is_table else stored(docs.select(id_col, text_col), "texts"), id_col, text_col)
    parted, piece_texts = pieces.parted, pieces.texts
    path = dictionary(_place_units(d, parted), pieces)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, known_ids = None, None, None
        fs, root = file_system(path)
        decode = decoder(piece_texts)
        for batch in batches:
            row = 0
            for span, place, texts in _rows_by_place(batch):
                if (span, place) != at and any(texts):
                    known = known_ids = None  # let go before the next one is read
                    pa.default_memory_pool().release_unused()
                    known, known_ids = _place_ids(fs, f"{root}/span={span}", place)
                    at = span, place
                ids, ends = ids_of(texts, parted, known, known_ids)
                cuts = pa.py_buffer(_offsets(ids)[np.append(0, ends)])
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, cuts, ids.buffers()[2]])
                columns = [batch.column("id").slice(row, len(texts)), ids.cast(pa.binary())]
                if decoded_as:
                    columns.append(pa.concat_arrays(list(decode(columns[1]))))
                # a batch for each part of the texts: a task never holds the ids of a whole batch
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text"][:len(columns)])
                row += len(texts)

    out = d.mapInArrow(apply, f"id {id_type}, ids binary" + ", text string" * bool(decoded_as))
    return out.toDF(id_col, "ids", *[decoded_as] * bool(decoded_as))


def ids_of(texts: list[bytes], parted: bool, known: pa.Array | None, known_ids: pa.Array | None) -> tuple[pa.Array, np.ndarray]:
    """Ids of the units of the texts, one after the other, and where each text's units end."""
    units, ends = cut_units(texts, parted)
    if not len(units):
        return pa.array([b""], pa.large_binary()), ends
    which = pc.index_in(units, value_set=known)
    if which.null_count:
        raise KeyError("a unit is not in its span's dictionary")
    return known_ids.take(which), ends


def decoder(texts: list[bytes]) -> Callable[[pa.Array], Iterator[pa.Array]]:
    """Decodes an array of encoded ids, part by part, by the texts of the pieces."""
    shown = pa.array(texts, pa.large_binary())

    def decode(batch: pa.Array) -> Iterator[pa.Array]:
        batch = pc.fill_null(batch, b"").cast(pa.large_binary())
        cuts, at = _offsets(batch), 0
        while at < len(batch):  # a part of the batch: the texts of a whole one are never held
            n = max(1, int(np.searchsorted(cuts[at + 1:], cuts[at] + TEXT_BYTES, "right")))
            ends = (cuts[at:at + n + 1] - cuts[at]) // 4
            flat = np.frombuffer(batch.buffers()[2] or b"", "<u4", int(ends[-1]), int(cuts[at])) if ends[-1] else np.zeros(0, "<u4")
            parts = shown.take(pa.array(flat))
            ends = _offsets(parts)[ends].tolist() if len(parts) else [0] * (n + 1)
            raw = parts.buffers()[2].to_pybytes() if ends[-1] else b""
            yield pa.array([raw[i + (raw[i:i + 1] == b" " and i < j):j].decode("utf-8", "replace")
                            for i, j in zip(ends, ends[1:])], pa.string())
            at += n
        if not len(batch):
            yield pa.array([], pa.string())

    return decode


def decoded(ids: Column, pieces: Pieces) -> Column:
    """Text of encoded ids: the pieces' texts one after the other, without the prefix's blank."""
    texts = pieces.texts

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = decoder(texts)
        for batch in batches:
            yield from decode(batch)

    join.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(join, "string")(ids)
