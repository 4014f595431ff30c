"""Alignment of the tokens that two tokenizers make of the same text.

Byte offsets where a token of either ends cut a text into groups; the two tokens that end at such
an offset are linked. How often each pair of ids is linked is counted over the corpus with a
minimal perfect hash of the distinct pairs: every task adds its links to a dense vector indexed by
the hash, slices of the vectors are summed in a tree, and a second pass aligns the documents again
and looks the counts up. Texts are tokenised once; the ids travel as a written table.

Two linked tokens end together, so the bytes of one are the end of the other's. An id therefore
has at most as many kinds of partner as it has bytes, and the distinct pairs, their hash and their
counts are bounded by the two vocabularies, whatever the corpus (``most_pairs``).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralume.session import materialize

from .common import worker_state
from .perfect import PerfectHash, build_segment, segment_of
from .tokens import KEPT_LENGTH, KEPT_PIECES, batches, encoder

SEGMENT_PAIRS = 1 << 14  # pairs in a segment of the hash, about
SLICE = 1024  # slots in a slice of a count vector
FAN = 256  # vectors that a node of the first tree level adds up


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes.

    Printable bytes stand for themselves, the others for the code points from 256 up.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; ids of other tokens have their text."""
    with open(path, encoding="utf-8") as source:
        settings = json.load(source)
    named = dict(settings["model"]["vocab"])
    for token in settings.get("added_tokens", []):
        named.setdefault(token["content"], token["id"])
    of = byte_characters()
    out = [b""] * (max(named.values()) + 1)
    for token, number in named.items():
        out[number] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
    return out


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()
        for k, piece in ((k, model.id_to_piece(k)) for k in range(model.get_piece_size()))
    ]


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """A bound for the distinct linked pairs of two vocabularies: of each pair, one token ends with the other."""
    same = [max(Counter(x for x in v if x).values(), default=0) for v in (a, b)]
    return sum(map(len, a)) * same[1] + sum(map(len, b)) * same[0]


class Pieces:
    """Texts to piece ids by sentencepiece, each word once.

    No piece of a model with word starts has U+2581 behind another character, and none a line
    feed, so merges never cross the start of a word or a line feed: the ids of a text are those
    of its words. Texts with blanks in a row or U+2581 go to the library whole, as do all
    texts of a model with other pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        probe = self.model.encode("\n")
        self.by_words = (
            not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
            and len(probe) == 2
            and pieces[probe[0]] == "▁"
            and self.model.encode("  a  ") != self.model.encode("a")  # blanks are kept
        )
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        # A word after a line feed has no blank before it; the blank that the library adds goes.
        return {
            w: np.array(ids[1:] if w[0] == "\n" else ids, "<u4").tobytes()
            for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True)
        }

    def batch(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        cut: list[list[str] | None] = []
        for text in texts:
            words = text.replace("\n", " \n").split(" ") if self.by_words and "▁" not in text else [""]
            cut.append(None if "" in words else words)
        if len(self.known) > KEPT_PIECES:
            self.known = {}
        known = self.known
        new = {w for words in cut if words for w in words if w not in known}
        found = self._learn(list(new))
        known.update(found)
        out = [
            b"".join([known[w] for w in words]) if words else np.array(self.model.encode(text), "<u4").tobytes()
            for text, words in zip(texts, cut, strict=True)
        ]
        for w in found:
            if len(w) > KEPT_LENGTH:
                del known[w]
        return out


class Tokens:
    """What a worker needs of the two vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np

        self.bytes_a, self.bytes_b = byte_level_bytes(path_a), piece_bytes(path_b)
        self.len_a, self.len_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.stride = len(self.bytes_b)
        self.kind = "<u2" if max(len(self.bytes_a), self.stride) <= 1 << 16 else "<u4"
        width = len(str(max(len(self.bytes_a), self.stride))) + 1
        marked = lambda size, marks: np.array([f"{k}{m}" for m in marks for k in range(size)], f"S{width}")
        self.written_a, self.written_b = marked(len(self.bytes_a), [",", "|"]), marked(self.stride, [",", ";", ""])

    def encoded(self, texts: list[str | None], path_a: str, path_b: str) -> tuple[list[bytes], list[bytes]]:
        """Ids of both sides; none where the tokens' bytes are not those of a blank and the text."""
        import numpy as np

        own = [t or "" for t in texts]
        sides = []
        for found, table in (
            (encoder(path_a, plain=True).batch([t and " " + t for t in own]), self.bytes_a),
            (worker_state(f"pieces {path_b}", lambda: Pieces(path_b)).batch(own), self.bytes_b),
        ):
            ids = [np.frombuffer(x, "<u4") for x in found]
            same = [not t or b"".join([table[i] for i in x.tolist()]) == b" " + t.encode() for t, x in zip(own, ids, strict=True)]
            sides.append((ids, same))
        fits = [bool(t) and p and q for t, p, q in zip(own, sides[0][1], sides[1][1], strict=True)]
        return tuple([x.astype(self.kind).tobytes() if f else b"" for x, f in zip(ids, fits, strict=True)] for ids, _ in sides)  # type: ignore[return-value]

    def ids(self, column) -> tuple:
        """All ids of a binary column and the place behind each row's last."""
        import numpy as np

        rows = column.to_pylist()
        ends = np.cumsum([len(x) for x in rows], dtype=np.int64) // np.dtype(self.kind).itemsize
        return np.frombuffer(b"".join(rows), self.kind).astype(np.int64), ends

    def last(self, a, b) -> tuple:
        """Which tokens of either side end a group; the texts of a batch stand one after the other."""
        import numpy as np

        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        size = int(ends_a[-1]) + 1 if len(ends_a) else 1
        mark_a, mark_b = np.zeros(size, bool), np.zeros(size, bool)
        mark_a[ends_a], mark_b[ends_b] = True, True
        return mark_b[ends_a], mark_a[ends_b]

    def written(self, a, b, last_a, last_b, ends_a, ends_b):
        """Groups as text, one value a row."""
        import numpy as np
        import pyarrow as pa

        behind_a, behind_b = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (last_a, last_b))
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        mark_b = last_b.astype(np.int64)
        mark_b[ends_b[ends_b > 0] - 1] = 2
        out = np.empty(len(a) + len(b), self.written_a.dtype)
        out[np.arange(len(a)) + behind_b[group_a]] = self.written_a[a + last_a * len(self.bytes_a)]
        out[np.arange(len(b)) + behind_a[group_b + 1]] = self.written_b[b + mark_b * self.stride]
        flat = out.view(np.uint8)
        ends = np.concatenate([[0], np.cumsum(np.char.str_len(out))])[np.concatenate([[0], ends_a + ends_b])]
        data = flat[flat != 0]
        return pa.Array.from_buffers(pa.string(), len(ends_a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _tokens(path_a: str, path_b: str) -> Tokens:
    return worker_state(f"aligned {path_a} {path_b}", lambda: Tokens(path_a, path_b))


def _runs(frame) -> Iterator:
    """A batch of stored ids in runs of bounded size."""
    low = size = 0
    for k, n in enumerate(frame.column("a").to_pylist()):
        size += len(n)
        if size >= 1 << 20:
            yield frame.slice(low, k + 1 - low)
            low, size = k + 1, 0
    yield frame.slice(low)


def tokenised(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``a``, ``b`` (ids of either side), ``pairs`` (linked pairs that the task has not met before)."""

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tokens = _tokens(path_a, path_b)
        met: set[int] = set()
        for frame in frames:
            texts = frame.column(1).to_pylist()
            for low, high in batches(texts):
                columns = [pa.array(side, pa.binary()) for side in tokens.encoded(texts[low:high], path_a, path_b)]
                (a, _), (b, _) = map(tokens.ids, columns)
                last_a, last_b = tokens.last(a, b)
                new = [p for p in np.unique(a[last_a] * tokens.stride + b[last_b]).tolist() if p not in met]
                met.update(new)
                pairs = pa.array([new] + [[]] * (high - low - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(low, high - low), *columns, pairs], names=["key", "a", "b", "pairs"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(work, f"key {kind}, a binary, b binary, pairs array<long>"), "tokens")


def hashed_pairs(rows: DataFrame, limit: int) -> list[tuple[list[int], bytes, bytes]]:
    """The segments of a perfect hash over the distinct pairs of ``rows``; ``limit`` bounds their number."""
    pairs = materialize(rows.select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    count = pairs.count()
    if count > limit:
        raise ValueError(f"{count} pairs of ids, the vocabularies allow {limit}")
    segments = max(1, -(-count // SEGMENT_PAIRS))

    def dealt(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for frame in frames:
            keys = frame.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(keys, segments)), frame.column(0)], names=["segment", "pair"])

    def built(group):
        import pyarrow as pa

        sizes, bits, keys = build_segment(group.column("pair").to_numpy())
        return pa.table({"segment": group.column("segment")[:1], "sizes": [sizes], "bits": [bits], "keys": [keys]})

    made = pairs.mapInArrow(dealt, "segment long, pair long").groupBy("segment").applyInArrow(built, "segment long, sizes array<long>, bits binary, keys binary")
    found = {r["segment"]: (r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in made.collect()}
    return [found.get(k, ([], b"", b"")) for k in range(segments)]


def _added(partial: DataFrame, fan: int) -> DataFrame:
    """One level of the tree: vectors of a slice whose nodes share a parent are added, one in memory at a time."""

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"slice": [held[0]], "node": [held[1]], "counts": [total.tobytes()]}, schema=kinds)
        for frame in frames:
            for place, node, data in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if (place, node) == held:
                    total += np.frombuffer(data, "<i8")
                    continue
                if held is not None:
                    yield out()
                held, total = (place, node), np.frombuffer(data, "<i8").copy()
        if held is not None:
            yield out()

    import pyarrow as pa

    kinds = pa.schema([("slice", pa.int64()), ("node", pa.int64()), ("counts", pa.binary())])
    rows = partial.select("slice", F.floor(F.col("node") / fan).alias("node"), "counts")
    return rows.repartition("slice", "node").sortWithinPartitions("slice", "node").mapInArrow(work, "slice long, node long, counts binary")


def linked(rows: DataFrame, path_a: str, path_b: str, segments: list) -> bytes:
    """How often each pair is linked over all rows, as a dense vector in order of slots."""
    import numpy as np

    size = sum(len(s[2]) for s in segments) // 8
    shared = rows.sparkSession.sparkContext.broadcast(segments)

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tokens, table = _tokens(path_a, path_b), PerfectHash(shared.value)
        total = np.zeros(-(-size // SLICE) * SLICE, np.int64)
        for frame in frames:
            for run in _runs(frame):
                (a, _), (b, _) = tokens.ids(run.column("a")), tokens.ids(run.column("b"))
                last_a, last_b = tokens.last(a, b)
                slots = table.slots(a[last_a] * tokens.stride + b[last_b])
                if len(slots) and slots.min() < 0:
                    raise ValueError("a linked pair is not in the hash")
                total += np.bincount(slots, minlength=len(total))
        cut = total.reshape(-1, SLICE)
        used = np.flatnonzero(cut.any(1))
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"slice": pa.array(used, pa.int64()), "node": pa.array([node] * len(used), pa.int64()), "counts": pa.array([cut[k].tobytes() for k in used], pa.binary())})

    partial = rows.select("a", "b").mapInArrow(work, "slice long, node long, counts binary")
    summed = {r["slice"]: bytes(r["counts"]) for r in _added(_added(partial, FAN), 1 << 62).collect()}
    shared.unpersist()
    whole = b"".join(summed.get(k, bytes(8 * SLICE)) for k in range(-(-size // SLICE)))
    return np.frombuffer(whole, "<i8")[:size].tobytes()


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups``.

    ``path_a`` is a byte-level vocabulary for a blank and the text, ``path_b`` a sentencepiece model
    for the text. ``groups`` lists ids as ``a1,a2|b1;a3|b2,b3``. ``n_best`` are the links whose pair is
    the most frequent one of its second id in the corpus, ties included; ``count_sum`` adds the
    counts of all links. Null and empty texts, and texts whose tokens don't spell them, have zeros
    and no groups. Rows are never joined, so null and repeated keys and other columns do no harm;
    an empty table gives an empty result.
    """
    rows = tokenised(docs, path_a, path_b, key, text)
    limit = most_pairs(byte_level_bytes(path_a), piece_bytes(path_b))
    segments = hashed_pairs(rows, limit)
    shared = rows.sparkSession.sparkContext.broadcast((segments, linked(rows, path_a, path_b, segments)))

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        tokens = _tokens(path_a, path_b)
        table, counts = PerfectHash(shared.value[0]), np.frombuffer(shared.value[1], "<i8")
        second = (table.keys % np.uint64(tokens.stride)).astype(np.int64)
        most = np.zeros(tokens.stride, np.int64)
        np.maximum.at(most, second, counts)
        best = counts == most[second]
        for frame in frames:
            for run in _runs(frame):
                (a, ends_a), (b, ends_b) = tokens.ids(run.column("a")), tokens.ids(run.column("b"))
                last_a, last_b = tokens.last(a, b)
                slots = table.slots(a[last_a] * tokens.stride + b[last_b])
                if len(slots) and slots.min() < 0:
                    raise ValueError("a linked pair is not in the hash")
                before = lambda values, ends: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], ends])])
                groups = before(last_a, ends_a)
                links = np.cumsum(groups)
                columns = [np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0), groups, groups, before(best[slots], links), before(counts[slots], links)]
                texts = tokens.written(a, b, last_a, last_b, ends_a, ends_b)
                yield pa.RecordBatch.from_arrays([run.column("key"), *[pa.array(c, pa.int64()) for c in columns], texts], names=names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups string"
    return rows.select("key", "a", "b").mapInArrow(work, schema).withColumnRenamed("key", key)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a``, ``b``, ``count``: how often two ids are linked over all documents."""
    rows = tokenised(docs, path_a, path_b, key, text)
    b = piece_bytes(path_b)
    segments = hashed_pairs(rows, most_pairs(byte_level_bytes(path_a), b))
    counts = linked(rows, path_a, path_b, segments)
    import pandas as pd
    import numpy as np

    keys = np.frombuffer(b"".join(s[2] for s in segments), "<u8").astype(np.int64)
    table = pd.DataFrame({"a": keys // len(b), "b": keys % len(b), "count": np.frombuffer(counts, "<i8")})
    return docs.sparkSession.createDataFrame(table, "a long, b long, count long")
