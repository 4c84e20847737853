r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are
context, only its reply is trainable. A conversation that does not end with an
assistant turn has one more example without a target, so that the formatted
output holds every turn.

Template of a turn: ``<s>[INST]role[/INST]text</s>``. Control strings inside
roles and texts are escaped by stuffing: one more backslash goes after the
first character of ``<\*/?s>`` and ``[\*/?INST]`` (``\*``: any number of
backslashes), and reading takes one away. No other character changes.

The examples of one conversation are made in one row and exploded from there:
one shuffle by conversation, none to read back. A conversation's turns have to
fit into a row, and so has the sum of its examples, which grows with the
square of its turns; conversations are spread by their own identifiers, which
a common first turn or copied conversations do not skew.

Defined results: turns go by turn number (null first), ties by role and text;
repeated rows are turns of their own. Null role and text count as empty. Rows
without a conversation identifier form one conversation. An empty table gives
no rows. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed control strings of the template
TURN_OPEN, ROLE_END, TURN_CLOSE = "<s>[INST]", "[/INST]", "</s>"
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(c, r"\[(\\*/?INST\])", r"[\\$1")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, r"<\\(\\*/?s>)", "<$1")
    return F.regexp_replace(c, r"\[\\(\\*/?INST\])", "[$1")


def format_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_length in
    characters (0, 0 without a target), has_target."""
    d = turns.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    d = d.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), F.concat(F.lit(TURN_OPEN), escape(t["role"]), F.lit(ROLE_END)).alias("head"),
        escape(t["text"]).alias("body"))))
    d = d.withColumn("written", F.transform(
        "turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_CLOSE))))
    last = F.size("turns") - 1
    at = F.filter(F.sequence(F.lit(0), last),
                  lambda i: (F.col("turns")[i]["role"] == TRAINED_ROLE) | (i == last))
    d = d.select("conv_id", "turns", "written", F.posexplode(at).alias("example", "i"))
    turn = F.col("turns")[F.col("i")]
    trained = turn["role"] == TRAINED_ROLE
    context = F.array_join(F.slice("written", F.lit(1), F.col("i")), "")
    d = d.select("conv_id", "example", context.alias("context"), turn["head"].alias("head"),
                 turn["body"].alias("body"), trained.alias("has_target"))
    start = F.char_length("context") + F.char_length("head")
    return d.select("conv_id", F.col("example").cast("long").alias("example"),
                    F.concat("context", "head", "body", F.lit(TURN_CLOSE)).alias("formatted"),
                    F.when(F.col("has_target"), start).otherwise(0).cast("long").alias("loss_start"),
                    F.when(F.col("has_target"), F.char_length("body")).otherwise(0).cast("long").alias("loss_length"),
                    "has_target")


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted example, unescaped."""
    parts = F.split(formatted, TURN_CLOSE, -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inner = F.transform(parts, lambda p: F.substring(p, len(TURN_OPEN) + 1, 2 ** 31 - 1))

    def turn(p: Column) -> Column:
        end = F.instr(p, ROLE_END)
        return F.struct(unescape(F.substring(p, F.lit(1), end - 1)).alias("role"),
                        unescape(F.substring(p, end + len(ROLE_END), F.lit(2 ** 31 - 1))).alias("text"))

    return F.transform(inner, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what the formatted examples hold, one row a conversation."""
    loss = unescape(F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    d = examples.select("conv_id", "example", "formatted", F.when(F.col("has_target"), loss).alias("loss"))
    d = d.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"))
    d = d.select("conv_id", read_turns(F.col("whole")).alias("turns"), "formatted_chars",
                 F.array_join(F.transform("losses", lambda x: F.coalesce(x["loss"], F.lit(""))), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.col("formatted_chars").cast("long").alias("formatted_chars"))
