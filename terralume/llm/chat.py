"""Chat formatting with DataFrame functions only.

The turns of a conversation are collected as structs, partially on the map side, and sorted.
Adjacent turns of one role become one block by array aggregation, and blocks are concatenated:

    <|im_start|>role
    text<|im_sep|>text of the next turn<|im_end|>

A control string inside a role or a text gets a backslash behind its first character; if
backslashes stand there already, one more. Taking one away restores the text, so the output
gives back every turn. The loss mask covers the texts of the roles that are learnt, as runs of
UTF-8 bytes: outside, inside, outside, and so on. Bytes are cut in time that does not grow with the
place of the cut, so reading grows with the length of a conversation and not with its square.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

SLICE = 128  # numbers that are summed in one go
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of chat templates in use; all are escaped inside texts.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# In patterns: a control string's first character, and what must follow.
_FIRSTS: dict[str, list[str]] = {}
for _c in CONTROLS:
    _FIRSTS.setdefault(_c[0], []).append(_c[1:])


def escaped(text: Column) -> Column:
    """One more backslash behind the first character of what could be read as a control string."""
    for first, rest in _FIRSTS.items():
        follows = "|".join(map(re.escape, rest))
        text = F.regexp_replace(text, rf"(?<={re.escape(first)})(\\*)(?={follows})", "$1\\\\")
    return text


def unescaped(text: Column) -> Column:
    """One backslash less at each such place."""
    for first, rest in _FIRSTS.items():
        follows = "|".join(map(re.escape, rest))
        text = F.regexp_replace(text, rf"(?<={re.escape(first)})(\\*)\\(?={follows})", "$1")
    return text


def _role_out(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(written: Column) -> Column:
    parts = F.split(unescaped(written), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``key``, ``n_turns``, ``n_blocks``, ``formatted``, ``loss_runs`` for each conversation.

    ``loss_runs`` holds lengths in UTF-8 bytes, alternately outside and inside the loss mask, beginning
    outside, one pair for each turn. Turns lie in order of ``turn``, nulls first; ties by role, then
    text. Null roles and texts count as empty; a null key is a conversation of its own, repeated rows
    are turns of their own. Other columns are ignored, an empty table gives no rows.
    """
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    got = turns.select(F.col(key).alias(key), row.alias("row")).groupBy(key).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    rows = F.col("rows")
    first = lambda i: (i == 0) | (F.get(rows, i)["role"] != F.get(rows, i - 1)["role"])
    begins = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), first)
    got = got.withColumn("begins", begins)
    begins = F.col("begins")

    def block(begin: Column, nth: Column) -> Column:
        n = F.coalesce(F.get(begins, nth + 1), F.size(rows)) - begin
        turns_of = F.slice(rows, begin + 1, n)
        return F.struct(F.get(rows, begin)["role"].alias("role"), F.transform(turns_of, lambda r: escaped(r["text"])).alias("texts"))

    got = got.withColumn("blocks", F.transform(begins, block))
    head = lambda b: F.concat(F.lit(START), _role_out(b["role"]), F.lit("\n"))
    body = lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END + "\n"))

    def runs(b: Column) -> Column:
        learn = b["role"].isin(*learnt)
        skipped = lambda i: F.when(i == 0, F.octet_length(head(b))).otherwise(F.lit(len(SEP)))
        last = lambda i: F.when(i == F.size(b["texts"]) - 1, F.lit(len(END) + 1)).otherwise(F.lit(0))
        # A turn outside the mask is a run outside with an empty run inside.
        return F.flatten(
            F.transform(
                b["texts"],
                lambda t, i: F.when(learn, F.array(skipped(i), F.octet_length(t), last(i), F.lit(0))).otherwise(
                    F.array(skipped(i) + F.octet_length(t) + last(i), F.lit(0))
                ),
            )
        )

    return got.select(
        key,
        F.size("rows").cast("long").alias("n_turns"),
        F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("blocks", body), "").alias("formatted"),
        F.flatten(F.transform("blocks", runs)).alias("loss_runs"),
    )


def turns_back(text: Column) -> Column:
    """The turns of a formatted text as structs of ``role`` and ``text``."""
    blocks = F.filter(F.split(text, re.escape(START)), lambda b: b != "")

    def of(block: Column) -> Column:
        role = _role_back(F.substring_index(block, "\n", 1))
        texts = F.split(F.substring(block, F.length(F.substring_index(block, "\n", 1)) + 2, F.length(block)), f"{re.escape(END)}\n", 2)
        return bind(role, lambda r: F.transform(F.split(F.get(texts, F.lit(0)), re.escape(SEP), -1), lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    return F.flatten(F.transform(blocks, of))


def _sums(numbers: Column) -> Column:
    """Running sums of a short array; the copies made grow with the square of its length."""
    return F.aggregate(
        numbers,
        F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("sums")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"] + n)).alias("sums")),
        lambda s: s["sums"],
    )


def running_sums(numbers: Column) -> Column:
    """Running sums of a non-empty array: within slices, then shifted by the sum of the slices before."""
    starts = F.sequence(F.lit(0), F.size(numbers) - 1, F.lit(SLICE))
    within = F.transform(starts, lambda i: _sums(F.slice(numbers, i + 1, F.lit(SLICE))))

    def shifted(slices: Column) -> Column:
        totals = _sums(F.transform(slices, lambda s: F.element_at(s, -1)))
        return bind(
            totals,
            lambda t: F.flatten(
                F.transform(slices, lambda s, k: F.transform(s, lambda n: n + F.coalesce(F.get(t, k - 1), F.lit(0))))
            ),
        )

    return bind(within, shifted)


def loss_texts(text: Column, runs: Column) -> Column:
    """The texts under the loss mask, in order."""

    def cut(ends: Column, raw: Column) -> Column:
        inside = F.filter(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: (i % 2 == 1) & (F.get(runs, i) > 0))
        piece = lambda i: F.substring(raw, F.get(ends, i) - F.get(runs, i) + 1, F.get(runs, i))
        return F.transform(inside, lambda i: unescaped(piece(i).cast("string")))

    cuts = bind(running_sums(runs), lambda ends: bind(text.cast("binary"), lambda raw: cut(ends, raw)))
    return F.when(F.size(runs) > 0, cuts).otherwise(F.array().cast("array<string>"))


def digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted texts give back: turns and loss texts, counted and hashed."""
    read = chats.withColumn("turns", turns_back(F.col("formatted"))).withColumn("loss", F.array_join(loss_texts(F.col("formatted"), F.col("loss_runs")), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
