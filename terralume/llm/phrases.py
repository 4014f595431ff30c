"""Phrases of a few words that occur together more often than their parts, by partitioned mining.

The corpus is cut into shards by a hash of the text. A shard grows with the corpus and is mined by many
tasks, so few shards do, and few lower the support least. A phrase with enough occurrences in the
corpus must reach its proportional share in at least one shard, so every shard is mined completely,
by length, at a support lowered to its share of a language's words; what is frequent in any shard
is a candidate. A last scan counts all candidates exactly over the whole corpus.

Tasks count a block of texts at a time in numpy. Mining works on 64-bit hashes of phrases: two
phrases of one hash only add a candidate. Longer phrases are looked for only where both shorter ones
are frequent in a shard, and the last scan writes only candidates. A blocked Bloom filter of at most
``FILTER_BYTES`` tells tasks which hashes are frequent; what it lets through wrongly is counted like the
rest and dropped by its true count, so results don't depend on its size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralume.session import materialize

SHARDS = 2  # with a support of 10 a phrase must occur 5 times in one of them
BLOCK_BYTES = 4 << 20  # text that a task counts at a time; a longer text is a block of its own
ROWS = 256  # rows of a batch that are Python objects at a time
FILTER_BYTES = 32 << 20  # most of the filter that all tasks get
SEGMENT_BYTES = 1 << 13  # a hash has its bits in one segment of the filter
PROBES = 4
UNKNOWN = "und"
# Bytes to bytes: upper case to lower, a tab to a blank, marks and line ends to a line feed.
MARKS = b".,;:!?\n\x0b\x0c\r"
WORDS = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_BYTES = bytes(10 if b in MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def remixed(values, seed: int = 0):
    import numpy as np

    x = values + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Block:
    """The words of some texts of one language, as numbers into their distinct words.

    Pieces are set apart by a number below 0. ``seed`` stands for the language in hashes.
    """

    def __init__(self, seed: int, texts: list[bytes]):
        import numpy as np
        import pyarrow as pa
        import xxhash

        data = (b" \n " + b"\n".join(texts).translate(_BYTES).replace(b"\n", b" \n ")).rstrip(b" ") + b" "
        at = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        # Each word is written with the blank before it; a blank alone is none.
        self.names = [w[1:] for w in words.dictionary.to_pylist()]
        ids = words.indices.to_numpy()
        place = {w: k for k, w in enumerate(self.names)}
        if b"" in place:
            ids = ids[ids != place[b""]]
        self.ids = np.where(ids == place.get(b"\n", -1), -1, ids)
        seed &= 0xFFFFFFFFFFFFFFFF
        own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))
        self.word_hash = own[ids] if len(ids) else np.zeros(0, np.uint64)

    def runs(self, longest: int) -> Iterator[tuple]:
        """For 1 to ``longest`` words: hashes of the runs from each place, and where such a run lies within a piece."""
        import numpy as np

        whole = self.ids >= 0
        found, inside = remixed(self.word_hash), whole
        yield found, inside
        for k in range(1, longest):
            found = remixed(found[:-1] * np.uint64(0x9DDFEA08EB382D69) ^ self.word_hash[k:], k)
            inside = inside[:-1] & whole[k:]
            yield found, inside


class Filter:
    """A blocked Bloom filter over hashes: a hash sets ``PROBES`` bits of one segment."""

    def __init__(self, data: bytes):
        import numpy as np

        self.bits = np.frombuffer(data, np.uint8)
        self.segments = len(data) // SEGMENT_BYTES

    @staticmethod
    def places(hashes):
        """Bits within a segment, one array for each probe."""
        import numpy as np

        mixed = remixed(hashes, 91)
        return [(mixed >> np.uint64(16 * k) & np.uint64(8 * SEGMENT_BYTES - 1)).astype(np.int64) for k in range(PROBES)]

    def has(self, hashes):
        import numpy as np

        base = (hashes % np.uint64(self.segments)).astype(np.int64) * SEGMENT_BYTES
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            found &= (self.bits[base + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def filter_of(hashes: DataFrame) -> Filter:
    """A filter over the column ``h``: 16 bits a hash, up to ``FILTER_BYTES``. Only its segments reach the driver."""
    segments = 1
    while segments * SEGMENT_BYTES < min(FILTER_BYTES, 2 * hashes.count()):
        segments *= 2

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, bits = -1, None
        done = lambda: pa.RecordBatch.from_pydict({"segment": [held], "bits": [bits.tobytes()]})
        for frame in frames:
            at = frame.column(0).to_numpy()
            own = frame.column(1).to_numpy().view(np.uint64)
            for segment in np.unique(at).tolist():
                if segment != held:
                    if held >= 0:
                        yield done()
                    held, bits = segment, np.zeros(SEGMENT_BYTES, np.uint8)
                for place in Filter.places(own[at == segment]):
                    np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        if held >= 0:
            yield done()

    # The number of segments is a power of two, so the low bits are the rest of the unsigned hash too.
    rows = hashes.select(F.col("h").bitwiseAND(segments - 1).alias("segment"), "h")
    made = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(work, "segment long, bits binary").collect()
    whole = bytearray(segments * SEGMENT_BYTES)
    for r in made:
        whole[r["segment"] * SEGMENT_BYTES : (r["segment"] + 1) * SEGMENT_BYTES] = r["bits"]
    return Filter(bytes(whole))


def blocks_of(frames: Iterator) -> Iterator[tuple]:
    """Texts (first column) by the values of the others, in blocks of bounded size."""
    held: dict[tuple, list[bytes]] = {}
    size = 0
    for frame in frames:
        for k in range(0, frame.num_rows, ROWS):
            text, *others = frame.slice(k, ROWS).columns
            for text, *of in zip(text.cast("binary").to_pylist(), *(c.to_pylist() for c in others), strict=True):
                held.setdefault(tuple(of), []).append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _texts(docs: DataFrame, text: str, lang: str, shards: int) -> DataFrame:
    """Texts with the language, its number (a hash), and the shard."""
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    number = F.xxhash64(F.lit("lang"), "lang").alias("number")
    return rows.select("text", "lang", number, F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard")).where("text <> ''")


def _mined(rows: DataFrame, lengths: list[int], shorter: Filter | None) -> DataFrame:
    """``h``, ``number``, ``shard``, ``count`` of the phrases of each shard and language.

    With ``shorter`` only phrases whose two shorter ones pass are counted.
    """
    shared = rows.sparkSession.sparkContext.broadcast(shorter and shorter.bits.tobytes())

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kept = Filter(shared.value) if shared.value else None
        for (number, shard), texts in blocks_of(frames):
            short = None
            for length, (hashes, inside) in enumerate(Block(number, texts).runs(max(lengths)), 1):
                if length in lengths:
                    place = np.flatnonzero(inside)
                    if kept is not None:
                        place = place[kept.has(short[place])]
                        place = place[kept.has(short[place + 1])]
                    found, counts = np.unique(hashes[place], return_counts=True)
                    # Shards and languages share a table, so that rows have one key.
                    of = np.array([number], np.int64)
                    for k in range(0, len(found), 1 << 17):
                        part, n = found[k : k + (1 << 17)], counts[k : k + (1 << 17)]
                        columns = [part.view(np.int64), np.repeat(of, len(n)), np.full(len(n), shard, np.int32), n.astype(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "number", "shard", "count"])
                short = hashes

    found = rows.select("text", "number", "shard").mapInArrow(work, "h long, number long, shard int, count long")
    return found.groupBy("h", "number", "shard").agg(F.sum("count").alias("count"))


def _frequent(mined: DataFrame, sizes: DataFrame, support: int) -> DataFrame:
    """Hashes that reach the share of the support that a shard's share of the words asks for."""
    least = F.ceil(F.lit(support).cast("decimal(18,0)") * F.col("words") / F.col("n"))
    return mined.join(sizes.select("number", "shard", least.alias("_least")), ["number", "shard"]).where("count >= _least").select("h")


def _counted(rows: DataFrame, longest: int, candidates: Filter) -> DataFrame:
    """``lang``, ``phrase``, ``length``, ``count`` over the whole corpus of all phrases that pass the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates.bits.tobytes())

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = Filter(shared.value)
        for (number, lang), texts in blocks_of(frames):
            block = Block(number, texts)
            words = pa.array(block.names, pa.binary()).cast(pa.string())
            for length, (hashes, inside) in enumerate(block.runs(longest), 1):
                place = np.flatnonzero(inside)
                place = place[kept.has(hashes[place])]
                order = place[np.argsort(hashes[place], kind="stable")]
                ids = np.stack([block.ids[order + k] for k in range(length)], 1)
                # Of equal hashes, equal words: a collision within a block splits the run or repeats a phrase.
                first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)])) if len(order) else order
                counts = np.diff(np.append(first, len(order)))
                for k in range(0, len(first), 1 << 16):
                    part = ids[first[k : k + (1 << 16)]]
                    phrases = pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in part.T], " ")
                    columns = [pa.array([lang] * len(part), pa.string()), phrases, pa.array(counts[k : k + (1 << 16)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "count"])

    found = rows.select("text", "number", "lang").mapInArrow(work, "lang string, phrase string, count long")
    counted = found.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    return counted.select("lang", "phrase", (F.regexp_count("phrase", F.lit(" ")) + 1).alias("length"), "count")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 10, longest: int = 3, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``support`` occurrences, and the words of each language.

    The first table has ``lang``, ``phrase``, ``length``, ``count``, the second ``lang``, ``n``.
    """
    rows = _texts(docs, text, lang, shards)
    words = materialize(rows.groupBy("lang", "number", "shard").agg(F.sum(F.regexp_count("text", F.lit(WORDS))).cast("long").alias("words")), "shard-words")
    totals = words.groupBy("lang").agg(F.sum("words").alias("n"))
    # Two languages of one number would share the lower support.
    sizes = words.join(totals, "lang").groupBy("number", "shard").agg(F.min(F.struct(F.col("words") / F.col("n"), "words", "n")).alias("_of")).select("number", "shard", "_of.words", "_of.n")
    sizes = materialize(sizes.where("words > 0"), "shard-sizes")
    frequent = materialize(_frequent(_mined(rows, [1, 2][:longest], None), sizes, support).distinct(), "frequent")
    for length in range(3, longest + 1):
        more = _frequent(_mined(rows, [length], filter_of(frequent)), sizes, support)
        frequent = materialize(frequent.unionByName(more).distinct(), "frequent")
    counted = _counted(rows, longest, filter_of(frequent)).where(F.col("count") >= support)
    return materialize(counted, "phrases"), totals


def scored(phrases: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``length``, ``a``, ``l``, ``r``, ``score`` of every phrase of two words or more.

    Counts may reach 10 ** 15: products are exact decimals.
    """
    own = phrases.where("length > 1").select("lang", "phrase", "length", F.col("count").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("_k")).select(
        "lang", "phrase", "length", "a", "_k",
        F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " ").alias("_first"),
        F.array_join(F.slice("_w", F.col("_k") + 1, F.col("length") - F.col("_k")), " ").alias("_rest"),
    )
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("count").alias(count))
    met = cuts.join(part("_first", "l"), ["lang", "_first"]).join(part("_rest", "r"), ["lang", "_rest"])
    worth = met.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    least = F.min(F.struct("score", "_k", "l", "r")).alias("_least")
    found = worth.groupBy("lang", "phrase", "length", "a").agg(least)
    return found.select("lang", "phrase", "length", "a", "_least.l", "_least.r", F.col("_least.score").cast("long").alias("score"))


def unabsorbed(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """Phrases without those that a longer phrase with ``percent`` of their occurrences contains."""
    longer = phrases.where("length > 2").select("lang", F.col("a").alias("_more"), "length", F.split("phrase", " ").alias("_w"))
    spans = longer.select("lang", "_more", "length", "_w", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("_n"))
    inside = spans.select("lang", "_more", "_w", "_n", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("_n") + 1)).alias("_at"))
    held = inside.select("lang", "_more", F.array_join(F.slice("_w", F.col("_at"), F.col("_n")), " ").alias("phrase")).groupBy("lang", "phrase").agg(F.max("_more").alias("_more"))
    return phrases.join(held, ["lang", "phrase"], "left").where(F.expr(f"_more is null or 100 * _more < {percent} * a")).drop("_more")


def ranked(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language with their ``rank``.

    Phrases are sorted over all tasks, so a language may be of any size: ranks are counts of what
    lies in the partitions before, and places within a partition.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    placed = materialize(phrases.repartitionByRange(F.col("lang").asc(), *order).withColumn("_part", F.spark_partition_id()), "sorted")
    before = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each sorting task
    sizes = placed.groupBy("lang", "_part").agg(F.count("*").alias("_rows")).select(
        "lang", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    near = placed.join(sizes.where(F.col("_before") < most), ["lang", "_part"])
    rank = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)) + F.col("_before")
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).drop("_part", "_before")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", support: int = 10, longest: int = 3, percent: int = 50, most: int = 2000, shards: int = SHARDS
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the strongest phrases of each language.

    Words are runs without blanks and tabs, lower-cased in A-Z; marks and line ends part a text into
    pieces, and phrases lie within pieces. ``score`` is 1,000,000 a² / (l r), rounded down, of the cut into
    two parts that gives the least; ties go to the first cut. A null language is ``und``. Null and empty texts have no words; every row
    counts, repeated ones too, whatever its other columns. An empty table gives an empty result.
    """
    phrases, sizes = frequent_phrases(docs, text, lang, support, longest, shards)
    kept = unabsorbed(materialize(scored(phrases), "scored"), percent)
    return ranked(kept, most).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
