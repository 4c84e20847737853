"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share, by weight, of a percentage of all words. No
target exceeds ``most`` times its source's size; what is above is shared again
by weight until none is above. That ends at one level L with target = least(cap,
weight * L), and L is the largest of (budget - caps before) / (weights not
before) over the sources in the order of cap / weight, so two prefix sums and a
maximum give it without a loop.

Within a source complete epochs come first: every document is taken
floor(target / size) times. The rest of the target is drawn without
replacement: a document gets the key -ln(u) / quality, u from a hash of its
identifier and text, documents are sorted by key within their source
(Efraimidis and Spirakis, "Weighted random sampling with a reservoir", 2006), and
the sizes before each decide whether it falls within the budget. The document
that reaches over it is taken up to the budget's last word, so the words taken
of a source are its target rounded down.

The sort is one range partitioning of narrow rows by (source, key), so a
source that holds a third of all rows lies in as many tasks as its rows need;
prefix sums go over partitions. Sources are a pre-aggregated table that is joined
back by the planner's choice.

Defined results: null text counts as empty and has no words; documents without
words take none. Null sources are one source, the last. A null identifier
hashes as the empty text. Rows that repeat identifier and text have equal
keys and are drawn one after the other. An empty table gives no rows. Reruns
agree whatever the partitioning. Other columns are ignored by ``mix`` and
passed through by ``mixed_documents``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import SPACES, free_name, prefix_sums, stored

WORD = SPACES.replace("[", "[^", 1)
#: what is not a letter of ASCII or a character beyond it
NO_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SEED = "13"


def letter_share(text: Column) -> Column:
    """Quality weight of a text in (0, 1]: its share of letters."""
    letters = F.length(F.regexp_replace(text, NO_LETTERS, ""))
    return (letters + 1).cast("double") / (F.length(text) + 1).cast("double")


def source_targets(sizes: DataFrame, weights: list[int], percent: int, most: int) -> DataFrame:
    """Add rank, start, target to sources (no_source, src, source_size).

    rank: place in the order of code points, null last; start: words of the sources before.
    """
    ranked = prefix_sums(sizes, ["no_source", "src"], {"rank": None, "start": F.col("source_size")})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * most})
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, all_weights = (total[0] or 0) * percent / 100, total[1] or 1
    filled = prefix_sums(ranked, ["ratio", "rank"], {"caps_before": F.col("cap"), "weights_before": F.col("weight")})
    level = filled.agg(F.max((F.lit(float(budget)) - F.col("caps_before")) / (all_weights - F.col("weights_before")))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(level or 0.0) * F.col("weight"))
    return ranked.select("no_source", "src", "source_size", "rank", "start", target.alias("target"))


def mix(docs: DataFrame, weights: list[int], percent: int = 100, most: int = 2, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", quality: Column | None = None,
        carry: list[str] | None = None) -> DataFrame:
    """id, source, size, source_size, target, epochs, part, taken [, row] for every row.

    Sizes are words. ``epochs``: complete copies; ``part``: words of one more copy; ``taken``: words in all.
    ``quality``: positive weight of a document, by default the share of letters in its text. ``carry``: columns to
    take along in the struct ``row``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    u = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    key = -F.log(u) / (letter_share(text) if quality is None else quality)
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).isNull().alias("no_source"),
                    F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"),
                    F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *extra)
    d = stored(d, "sizes")
    sizes = d.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, percent, most)
    d = prefix_sums(d, ["no_source", "src", "key", "id", "size"], {"before": F.col("size")})
    # a row for each source: the planner broadcasts it where its measured size allows
    d = d.join(targets, ["no_source", "src"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    d = d.withColumn("epochs", epochs.cast("long"))
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("before") - F.col("start"))))
    d = d.withColumn("part", part)
    return d.select(F.col("id").alias(id_col), F.when(~F.col("no_source"), F.col("src")).alias(source_col), "size",
                    "source_size", "target", "epochs", "part",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, weights: list[int], percent: int = 100, most: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs`` with words, once for each copy taken, the cut copy with its text cut
    after ``part`` words; a further column ``epoch`` counts the copies from 0."""
    epoch = free_name(docs, "epoch")
    d = mix(docs, weights, percent, most, id_col, text_col, source_col, quality, carry=docs.columns)
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    d = (d.filter((F.col("size") > 0) & (copies > 0))
         .select("row", "epochs", "part", "size", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy")))
    whole = F.col("row")[text_col]
    words = F.regexp_extract_all(whole, F.lit(f"{WORD}{SPACES.replace('+', '*')}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    text = F.when((F.col("copy") < F.col("epochs")) | (F.col("part") == F.col("size")), whole).otherwise(cut)
    return d.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
                    F.col("copy").alias(epoch))
