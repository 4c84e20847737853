"""Shortest-pack-first packing over the length histogram.

Documents become token ids (one pass, cut into pieces of at most ``capacity``
ids). Only the histogram of piece lengths, at most ``capacity`` counts, reaches
the driver. There the lengths are placed longest first into the open packs
with the most room, all equal packs at once, which yields packing patterns with
counts (Krell et al., "Efficient sequence packing without
cross-contamination", 2021). Every pattern takes an interval of the ranks of
each of its lengths; pieces get a rank among those of their length and look
their pattern, sequence and offset up by it.

Ranks are positions in a range partitioning by length and identifier, less the
pieces of smaller lengths, so a length that a third of all pieces have lies in as
many tasks as its pieces need.

Defined results: null text counts as empty, an empty document is the end id
alone. Null identifiers and repeated rows are documents of their own. An empty
table gives no rows. Other columns are ignored.
"""
from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import in_parts, prefix_sums, stored

CAPACITY = 2048
#: words whose ids a Python worker keeps, twice: the words met since the last turn, and those met before it; it keeps
#: them as long as it lives, beside the executor's heap
CACHE_WORDS = 100_000
CACHED_BYTES = 64
#: bytes of text tokenized together
GROUP_BYTES = 4 << 20
#: marks that the tokenizer never joins with a letter before them; the apostrophe is not one
MARKS = b".,;:!?%&$#*|"
#: letters of scripts that every version of the character tables has
KNOWN_LETTERS = "\u0530"
_BLANKS = bytes.maketrans(b"\n\t\r", b"   ")
_LOWER_BLANKS = bytes.maketrans(b"\n\t\r" + bytes(range(65, 91)), b"   " + bytes(range(97, 123)))


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte: itself where it is printable, else one beyond the bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    return {x: x for x in printable} | {x: 256 + i for i, x in enumerate(others)}


class WordEncoder:
    """Ids of UTF-8 texts.

    The tokenizer splits at white space before anything else, and letters from
    marks, so the ids of a text are those of its words one after the other. The
    words of a group of texts are made distinct, only those not met before are
    tokenized, and the ids of all words are gathered at once. It lower-cases, so
    words that differ in A-Z are one; only texts with combining marks, which may
    join with a small letter alone, or with the beginning of a special token keep
    their case. A run of letters goes straight to the tokenizer's BPE model,
    normalised and byte by byte as its pipeline would hand it over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # no thread for each core in each task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if self.model.end_of_word_suffix != "</w>" or self.model.continuing_subword_prefix or self.model.dropout:
            raise ValueError("only BPE models with word ends are supported")
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {b"": b""}
        self.before: dict[bytes, bytes] = {}

    def _run_of_letters(self, stem: bytes) -> str | None:
        """The stem as the BPE model gets it; None if it is not one run of letters, also once it is normalised:
        a letter that decomposes into a letter and a mark may join with what follows."""
        if stem.isalpha():  # of ASCII
            return stem.decode().lower()
        if not stem or stem.isascii():
            return None
        text = stem.decode("utf-8", "replace")
        if not text.isalpha() or max(text) >= KNOWN_LETTERS:
            return None
        text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return text.encode().decode("latin-1").translate(self.letters) if text.isalpha() else None

    def _tokenize(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of any words tokenized together, told apart by where each id's text starts."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in texts)])
        ends = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts)
        ids = array("I", found.ids).tobytes()
        return {w: ids[4 * i:4 * j] for w, i, j in zip(words, ends.tolist(), ends[1:].tolist())}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words: of a word of letters and closing marks those of its parts."""
        known, before, tokenize = self.known, self.before, self.model.tokenize
        new, ends, other = {}, [], []
        for w in words:
            if w in before:
                new[w] = before[w]
                continue
            stem = w.rstrip(MARKS)
            run = self._run_of_letters(stem)
            if run is None:
                other.append(w)
                continue
            ids = known.get(stem)
            if ids is None:
                ids = new.get(stem)
                if ids is None:
                    ids = new[stem] = array("I", [t.id for t in tokenize(run)]).tobytes()
            if len(stem) < len(w):
                ends.append((w, ids, w[len(stem):]))
        other += {m for _, _, m in ends if m not in known and m not in new}
        if other:
            new |= self._tokenize(list(dict.fromkeys(other)))
        for w, ids, marks in ends:
            new[w] = ids + (known[marks] if marks in known else new[marks])
        known.update((w, b) for w, b in new.items() if len(w) <= CACHED_BYTES)
        return new

    def group(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and where each text's ids end."""
        shown = b" ".join([*texts, b""])
        if any(x in shown for x in (b"\xcc", b"\xcd", b"<|")):
            shown = b" ".join([*(t.translate(_BLANKS if b"\xcc" in t or b"\xcd" in t or b"<|" in t else _LOWER_BLANKS)
                                 for t in texts), b""])
        else:
            shown = shown.translate(_LOWER_BLANKS)
        ends = np.flatnonzero(np.frombuffer(shown, np.uint8) == 32) + 1  # a word goes with its blank
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets),
                                                                              pa.py_buffer(shown)]).dictionary_encode()
        raw, cuts = words.dictionary.buffers()[2].to_pybytes(), np.frombuffer(words.dictionary.buffers()[1], np.int64)
        cuts = cuts[:len(words.dictionary) + 1].tolist()
        distinct = [raw[i:j - 1] for i, j in zip(cuts, cuts[1:])]
        known = self.known
        new = self._learn([w for w in distinct if w not in known])
        ids = [known[w] if w in known else new[w] for w in distinct]
        if len(known) > CACHE_WORDS:
            self.known, self.before = {b"": b""}, known
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        first = np.cumsum(sizes) - sizes
        which = words.indices.to_numpy()
        size = sizes[which]
        upto = np.cumsum(size)
        at = np.repeat(first[which] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        return flat[at], upto[np.searchsorted(ends, text_ends)]

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes, a group of texts at a time."""
        first = 0
        while first < len(texts):
            last, n = first, 0
            while last < len(texts) and (n == 0 or n + len(texts[last]) <= GROUP_BYTES):
                n += len(texts[last]) + 1
                last += 1
            ids, ends = self.group(texts[first:last])
            at = 0
            for end in ends.tolist():
                yield ids[at:end].tobytes()
                at = end
            first = last


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The Python worker's encoder: the words that one task met serve the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
               id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens [, ids]: a document's ids in runs of ``capacity`` and a rest."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids binary" if with_ids else ""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(tokenizer_path)
        for batch in (part for whole in batches for part in in_parts(whole)):
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
            of, start, length, crc, total, raw = [], [], [], [], [], []
            for i, data in enumerate(encode([t or b"" for t in texts.to_pylist()])):
                data += end
                n = len(data) // 4
                for at in range(0, n, capacity):
                    piece = data[4 * at:4 * (at + capacity)]
                    of.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        raw.append(piece)
            cols = [ids.take(pa.array(of, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns of a length histogram: ([(length, times), ...], number of packs)."""
    open_packs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # by room left
    rooms: list[int] = []  # ascending

    def put(room: int, pattern: list[tuple[int, int]], packs: int) -> None:
        if room not in open_packs:
            open_packs[room] = []
            insort(rooms, room)
        open_packs[room].append((pattern, packs))

    def added(pattern: list[tuple[int, int]], length: int, times: int) -> list[tuple[int, int]]:
        if pattern and pattern[-1][0] == length:
            return [*pattern[:-1], (length, pattern[-1][1] + times)]
        return [*pattern, (length, times)]

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0 and rooms and rooms[-1] >= length:
            room = rooms[-1]  # the shortest packs
            pattern, packs = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            use = min(packs, left)
            if use < packs:
                put(room, pattern, packs - use)
            put(room - length, added(pattern, length, 1), use)
            left -= use
        if left > 0:
            times = capacity // length
            if left >= times:
                put(capacity - length * times, [(length, times)], left // times)
            if left % times:
                put(capacity - length * (left % times), [(length, left % times)], 1)
    return [x for room in sorted(open_packs) for x in open_packs[room]]


class Places:
    """Where the pieces of each length go, by rank: sequence and offset."""

    def __init__(self, found: list[tuple[list[tuple[int, int]], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for pattern, packs in found:
            offset = 0
            for length, times in pattern:
                at = taken.get(length, 0)
                rows.setdefault(length, []).append((at, first, offset, times))
                taken[length] = at + packs * times
                offset += length * times
            first += packs
        self.rows = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = length == n
            low, first, start, times = self.rows[int(n)]
            k = np.searchsorted(low, rank[at], "right") - 1
            r = rank[at] - low[k]
            sequence[at], offset[at] = first[k] + r // times[k], start[k] + n * (r % times[k])
        return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces, which are read three times: pass a stored table."""
    histogram = {r["length"]: r["n"] for r in  # <= capacity rows
                 pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(patterns(histogram, capacity))
    shorter = np.zeros(capacity + 1, np.int64)  # pieces of smaller lengths
    for length, n in histogram.items():
        shorter[length + 1:] += n
    d = prefix_sums(pieces, ["length", "doc_id", "start", "ids_crc32"], {"position": None})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = places(length, batch.column("position").to_numpy() - shorter[length])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    return d.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens [, ids], sequence_id, offset."""
    return pack(stored(cut_pieces(docs, tokenizer_path, end_id, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The training sequences of pieces packed ``with_ids``: sequence_id, doc_ids, ids
    (little-endian unsigned 32-bit, padded to ``capacity``). A group holds ``capacity`` ids at most."""
    d = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    ids = F.concat(*[F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))])
    used = F.octet_length("ids") / 4
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(capacity) - used).cast("int")))
    return (d.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), ids.alias("ids"))
            .withColumn("ids", F.concat("ids", pad)))
