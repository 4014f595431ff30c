"""Quality rules, line first: lines that break a rule go, then documents that lose too much.

Only DataFrame functions are used, all within a row: no shuffle. Lines are judged for punctuation,
navigation and boilerplate; a document stays if enough of its words are left and if its whole text
is neither too short nor mostly repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, bind, free_name, words_of

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated windows
WINDOW = 3
LEAST_LEFT = 50  # per cent of words that must be left after the lines that failed have gone

SYMBOLS = r"[#*$%&|<>]"
# Phrases of site furniture and of licence headers, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "click here", "sign up for", "subscribe to our",
    "licensed under the", "released under the",
)


def window_codes(words: Column, bits: Column) -> Column:
    """A number for each window, in order: bits of its hash above, its place in the lowest ``bits``."""
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    code = lambda i: F.call_function("shiftleft", F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))), bits)
    return F.sort_array(F.transform(places, lambda i: code(i).bitwiseOR(i.cast("long"))))


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in windows found twice or more."""
    bits = F.ceil(F.log2(F.size(words) + 1)).cast("int")
    # Bound, as the optimizer may copy a column into the lambdas that use it.
    given = F.struct(words.alias("words"), bits.alias("bits"), (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("mask"))
    found = bind(given, lambda g: bind(window_codes(g["words"], g["bits"]), lambda codes: _covered(g["words"], codes, g["mask"])))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def _covered(words: Column, codes: Column, mask: Column) -> Column:
    """Words that lie in repeated windows.

    Equal windows are neighbours in ``codes``, so those whose upper bits equal a neighbour's are
    taken and compared word by word; their places in order give the words covered.
    """
    near = lambda a, b: (a.bitwiseXOR(b) >= 0) & (a.bitwiseXOR(b) <= mask)
    hits = F.filter(codes, lambda c, i: near(c, F.get(codes, i + 1)) | near(c, F.get(codes, i - 1)))
    places = F.transform(hits, lambda c: F.struct(c.alias("code"), c.bitwiseAND(mask).cast("int").alias("at")))

    def same(a: Column, b: Column) -> Column:
        equal = near(a["code"], b["code"])
        for k in range(WINDOW):
            equal = equal & (F.get(words, a["at"] + k) == F.get(words, b["at"] + k))
        return equal

    def confirmed(found: Column) -> Column:
        real = F.filter(found, lambda x, i: same(x, F.get(found, i + 1)) | same(x, F.get(found, i - 1)))
        return F.sort_array(F.transform(real, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda a, i: F.least(F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, s: total + s)

    return bind(bind(places, confirmed), covered)


def line_verdict(line: Column, words: Column) -> Column:
    """Name of the first rule that a line with words breaks, or null."""
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    shouted = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    ended = F.rtrim(line, F.lit(SPACES)).rlike(r"[.!?…:;。！？][\"'”’»)\]]*+$")
    return (
        F.when((5 * symbols > words) | (5 * shouted > words), F.lit("punctuation"))
        .when((words < 4) & ~ended, F.lit("navigation"))
        .when((words < 30) & F.lower(line).rlike("|".join(BOILERPLATE)), F.lit("boilerplate"))
    )


def judged(docs: DataFrame, text: str = "text", least_left: int = LEAST_LEFT) -> DataFrame:
    """``docs`` with a struct ``quality`` of counts, the cleaned text and the verdict.

    Fields: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``n_left``
    (words in the lines that stay), ``cleaned`` (those lines, with all lines without words) and ``kept``.
    A null text counts as empty: no words, so it fails. Every row is judged by itself, whatever
    its key; extra columns stay, and ``quality`` gets underscores in front where that name is taken.
    """
    p = free_name([c[: len("quality_")] for c in docs.columns], "quality_")
    name = free_name(docs.columns, "quality")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn(f"{p}words", words_of(F.col(f"`{text}`")))
    words = F.col(f"{p}words")
    rows = rows.withColumn(
        f"{p}counted", F.transform(F.split(whole, "\n", -1), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    )
    counted = F.col(f"{p}counted")
    stay = F.filter(counted, lambda x: (x["n"] == 0) | line_verdict(x["line"], x["n"]).isNull())
    with_words = F.transform(F.filter(counted, lambda x: x["n"] > 0), lambda x: x["line"])
    rows = rows.withColumns({
        f"{p}n": F.size(words).cast("long"),
        f"{p}repeat": repeated_words(words),
        f"{p}stay": stay,
        f"{p}dup": bind(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    rows = rows.withColumn(f"{p}left", F.aggregate(f"{p}stay", F.lit(0).cast("long"), lambda total, x: total + x["n"]))
    n, repeat, left = F.col(f"{p}n"), F.col(f"{p}repeat"), F.col(f"{p}left")
    failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)
    made = F.struct(
        n.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(whole, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.col(f"{p}dup").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        failed.alias("base_failed"),
        left.alias("n_left"),
        F.array_join(F.transform(f"{p}stay", lambda x: x["line"]), "\n").alias("cleaned"),
        (~failed & (100 * left >= least_left * n)).alias("kept"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(name))


def kept_rows(docs: DataFrame, text: str = "text", least_left: int = LEAST_LEFT) -> DataFrame:
    """The rows of ``judged`` that are kept."""
    rows = judged(docs, text, least_left)
    verdict, barrier = rows.columns[-1], free_name(rows.columns, "judged_row")
    # The number of a row keeps the filter above the rules, which would run twice otherwise.
    numbered = rows.withColumn(barrier, F.monotonically_increasing_id())
    return numbered.where(F.col(f"`{verdict}`.kept") & (F.col(barrier) >= 0)).drop(barrier)
