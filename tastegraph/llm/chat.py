r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs (one shuffle by conversation), sorted, folded so that neighbouring turns of one role share a
block, and joined to one text:

    ### User: first text<br/>second text of the same role</turn>
    ### Assistant: answer</turn>

(every block ends in ``</turn>`` and a newline; ``<br/>`` parts the turns of one block). Inside texts and unknown roles ``\``, ``#`` and ``<``
are written ``\b``, ``\h`` and ``\l``, so an unescaped ``#`` or ``<`` is always the template's, and reading back is exact.
The roles user, assistant and system have capitalised headings; any other role stands in square brackets, escaped likewise
(also ``]`` as ``\r`` and ``:`` as ``\c``; a null role is ``[\n]``).

``parsed`` reads the turns back from that text. ``loss_mask`` has a character for each code point of it: ``1`` over the escaped
texts of assistants, ``0`` elsewhere; the template is never under the mask. ``masked`` reads what is under it.

Defined cases: a null text is empty; a null role stays null; null conv_id groups as one conversation; turns sort by turn (nulls first),
then role, then text, so ties and repeated rows have one result and repeated rows stay; an empty table has no conversations; extra
columns are ignored, also such as have an output's name; a text may be as long as a string can be. A conversation is one row of the result by the operator's meaning, so all of its turns meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, BREAK = "</turn>", "<br/>"
_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``: every backslash starts one of three codes, and the one that makes backslashes comes last."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\b"), F.lit("\\"))


def _heading(role: Column) -> Column:
    named = F.when(role.isNull(), F.lit("[\\n]"))
    for key, name in _NAMES.items():
        named = named.when(role == key, F.lit(name))
    return named.otherwise(F.concat(F.lit("["), F.replace(F.replace(escaped(role), F.lit("]"), F.lit("\\r")), F.lit(":"), F.lit("\\c")), F.lit("]")))


def _role(heading: Column) -> Column:
    inner = F.substring(heading, 2, 2**31 - 1)
    role = F.when(heading == "[\\n]", F.lit(None).cast("string"))
    for key, name in _NAMES.items():
        role = role.when(heading == name, F.lit(key))
    return role.otherwise(unescaped(F.replace(F.replace(inner.substr(F.lit(1), F.length(inner) - 1), F.lit("\\r"), F.lit("]")), F.lit("\\c"), F.lit(":"))))


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss_mask: one text for each conversation, and its mask."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A turn opens a block unless its neighbour before has the same role; parts are joined once, so the cost is linear.
    same = lambda i: (i > 0) & F.get("turns", i - 1)["role"].eqNullSafe(F.get("turns", i)["role"])
    parts = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(
            F.when(same(i), F.lit(BREAK)).otherwise(F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit("### "), _heading(t["role"]), F.lit(": "))).alias("lead"),
            escaped(t["text"]).alias("text"),
            F.coalesce(t["role"] == "assistant", F.lit(False)).alias("own"),
        ),
    )
    mask = lambda p: F.concat(F.repeat(F.lit("0"), F.length(p["lead"])), F.repeat(F.when(p["own"], F.lit("1")).otherwise(F.lit("0")), F.length(p["text"])))
    return grouped.select("conv_id", parts.alias("parts")).select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END + "\n")).alias("formatted"),
        F.concat(F.array_join(F.transform("parts", mask), ""), F.lit("0" * len(END + "\n"))).alias("loss_mask"),
    )


def parsed(df: DataFrame, column: str = "formatted") -> DataFrame:
    """df with ``turns``: array of (role, text), read back from the formatted text."""
    blocks = F.filter(F.split(F.col(column), "</turn>\n", -1), lambda b: b != "")
    texts = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(b.substr(F.locate(": ", b) + 2, F.length(b)), BREAK, -1),
            lambda t: F.struct(_role(b.substr(F.lit(5), F.locate(": ", b) - 5)).alias("role"), unescaped(t).alias("text")),
        ),
    )
    return df.withColumn("turns", F.flatten(texts))


#: Runs of the mask that are cut from one slice of the text, so that neither scans the whole text for each run.
RUNS = 64


def masked(text: Column, mask: Column) -> Column:
    """The code points of ``text`` at the ones of ``mask``, in order: both are walked slice by slice, runs of equal mask characters inside each."""
    runs = F.regexp_extract_all(mask, F.lit("0+|1+"), F.lit(0))
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(runs) / RUNS).cast("int") - 1, F.lit(0))), lambda i: F.slice(runs, i * RUNS + 1, F.lit(RUNS)))
    start = lambda out: F.struct(F.lit(0).alias("at"), out.alias("out"))

    def inside(part: Column, these: Column) -> Column:
        step = lambda acc, r: F.struct((acc["at"] + F.length(r)).alias("at"), F.concat(acc["out"], F.when(F.startswith(r, F.lit("1")), part.substr(acc["at"] + 1, F.length(r))).otherwise(F.lit(""))).alias("out"))
        return F.aggregate(these, start(F.lit("")), step, lambda acc: acc["out"])

    def over(acc: Column, these: Column) -> Column:
        size = F.aggregate(these, F.lit(0), lambda n, r: n + F.length(r))
        found = F.get(F.transform(F.array(text.substr(acc["at"] + 1, size)), lambda part: inside(part, these)), F.lit(0))
        return F.struct((acc["at"] + size).alias("at"), F.array_append(acc["out"], found).alias("out"))

    return F.array_join(F.aggregate(slices, start(F.array().cast("array<string>")), over, lambda acc: acc["out"]), "")


def digests(df: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: turns read back from ``formatted``, the loss from what is under ``loss_mask``."""
    read = parsed(df)
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescaped(masked(F.col("formatted"), F.col("loss_mask")))
    return read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("_loss")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
