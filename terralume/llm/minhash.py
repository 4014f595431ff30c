"""Near-duplicate texts: MinHash signatures, a multi-index Hamming join, and an exact check.

A text's set holds its distinct word shingles. A signature has ``4 * chunks`` symbols of 16 bits.
Signatures that differ in at most ``2 * chunks - 1`` symbols have, by pigeonhole, a chunk of four
with at most one error, so they share that chunk with one symbol left out: each signature is
entered once for every symbol left out and every pair under the distance meets. ``chunks`` is the
least number for which a pair at the wanted similarity stays under the distance but for one
case in a million.

Texts with equal sets become one node first. The Hamming join yields only spanning links, and
their components (pools) hold every pair under the distance. Within a pool the full sets are
compared in blocks, and again only spanning links of the true similarity leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralume.session import materialize

from .common import worker_state
from .components import components

SHINGLE_WORDS = 5
MISSED = 1e-6
BUCKET = 2_000  # nodes of a bucket that are compared by signature; a larger bucket becomes one pool
BLOCK_SHINGLES = 500_000  # shingles of a block of a pool
BLOCK_NODES = 500  # nodes of a block of a pool


def chunks_for(similarity: float, missed: float = MISSED) -> int:
    """Least number of chunks that loses fewer than ``missed`` of the pairs at ``similarity``."""
    for chunks in range(4, 129):
        n, limit = 4 * chunks, 2 * chunks - 1
        lost = sum(math.comb(n, k) * (1 - similarity) ** k * similarity ** (n - k) for k in range(limit + 1, n + 1))
        if lost <= missed:
            return chunks
    raise ValueError("similarity too small for this method")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_set(text: str | None, width: int = SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the shingles of a whole text; a short text is one shingle."""
    import numpy as np

    # bytes.lower() changes A-Z alone, bytes.split() cuts at the six ASCII blanks.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_state("word hashes", _WordHashes)
    each = np.fromiter([known[w] for w in words], np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.full(n, len(words) if len(words) < width else width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(words))):
            mixed = (mixed ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _signatures(symbols: int) -> Callable[[Iterator], Iterator]:
    def work(frames):
        import numpy as np
        import pyarrow as pa
        import xxhash

        rng = np.random.default_rng(20240229)
        factors = rng.integers(0, 2**62, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 2**63, symbols, dtype=np.uint64)
        for frame in frames:
            rows, sets, held = [], [], 0
            out = []

            def flush(rows=rows, sets=sets, out=out):
                if not rows:
                    return
                joined = np.concatenate(sets)
                begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
                signs = np.empty((len(sets), symbols), "<u2")
                with np.errstate(over="ignore"):
                    for j in range(symbols):
                        mixed = joined * factors[j] + shifts[j]
                        signs[:, j] = np.minimum.reduceat(mixed, begins) >> np.uint64(40) & np.uint64(0xFFFF)
                out.extend((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), g.tobytes()) for i, s, g in zip(rows, sets, signs, strict=True))
                rows.clear()
                sets.clear()

            for i, t in enumerate(frame.column(1).to_pylist()):
                found = shingle_set(t)
                if len(found) == 0:
                    out.append((i, 0, None, None))
                    continue
                rows.append(i)
                sets.append(found)
                held += len(found)
                if held > 200_000:
                    flush()
                    held = 0
            flush()
            _, sizes, nodes, signs = zip(*sorted(out), strict=True) if out else ((),) * 4
            columns = [frame.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "node", "signature"])

    return work


def signed(docs: DataFrame, key: str, text: str, chunks: int) -> DataFrame:
    """``key``, ``n_shingles``, ``node`` (digest of the set, null for an empty one), ``signature``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_signatures(4 * chunks), f"key {kind}, n_shingles long, node binary, signature binary")


def _roots(parent, at):
    """Roots of the entries ``at`` in a numpy forest."""
    now = parent[at]
    while True:
        up = parent[now]
        if (up == now).all():
            return now
        now = up


def _merge(parent, left, right) -> list[int]:
    """Join the trees of each pair in turn; the positions that joined two."""
    used = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            used.append(k)
    return used


def _runs(frames: Iterator, column: str) -> Iterator:
    """Frames of rows sorted by ``column``, cut so that equal values stay together."""
    import pandas as pd

    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        last = frame[column].iloc[-1]
        cut = int(frame[column].searchsorted(last))
        rest = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _near_in_buckets(chunks: int) -> Callable[[Iterator], Iterator]:
    limit = 2 * chunks - 1

    def work(frames):
        import numpy as np
        import pandas as pd

        for frame in _runs((f for f in frames if len(f)), "bucket"):
            keys = frame["bucket"].to_numpy()
            signs = np.frombuffer(b"".join(frame["signature"]), "<u2").reshape(len(frame), 4 * chunks)
            nodes = frame["node"].to_numpy()
            parent = pd.factorize(pd.Series(nodes))[0]
            parent = pd.Series(np.arange(len(nodes))).groupby(parent).transform("min").to_numpy().copy()
            out = []
            longest = int(np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])).max())
            for step in range(1, longest):
                at = np.flatnonzero(keys[:-step] == keys[step:])
                if not len(at):
                    continue
                at = at[_roots(parent, at) != _roots(parent, at + step)]
                for k in range(0, len(at), 100_000):
                    part = at[k : k + 100_000]
                    part = part[(signs[part] != signs[part + step]).sum(1) <= limit]
                    part = part[_merge(parent, part, part + step)]
                    out += zip(nodes[part], nodes[part + step], strict=True)
            yield pd.DataFrame(out, columns=["a", "b"])

    return work


def near_pools(nodes: DataFrame, chunks: int) -> DataFrame:
    """``node``, ``root``: components that hold every pair of signatures under the distance.

    The members of a bucket over ``BUCKET`` are linked to its first one unseen; that can only make
    a pool larger, and the exact check follows.
    """
    masked = [
        F.xxhash64(F.lit(4 * c + m), *(F.substring("signature", 8 * c + 2 * s + 1, 2) for s in range(4) if s != m))
        for c in range(chunks)
        for m in range(4)
    ]
    entries = nodes.select("node", F.explode(F.array(*masked)).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
    hits = materialize(entries.join(shared, "bucket"), "hits")
    wide = hits.where(F.col("size") > BUCKET).select(F.col("node").alias("a"), F.col("first").alias("b"))
    narrow = hits.where(F.col("size") <= BUCKET).select("bucket", "node").join(nodes.select("node", "signature"), "node")
    dealt = narrow.repartition("bucket").sortWithinPartitions("bucket", "node").select("bucket", "node", "signature")
    return components(dealt.mapInPandas(_near_in_buckets(chunks), "a binary, b binary").unionByName(wide))


def similar_sets(sets: list, percent: int):
    """For each set the position of the first one that links of similarity reach, itself included."""
    import numpy as np

    k = len(sets)
    lengths = np.array([len(s) for s in sets])
    joined, owner = np.concatenate(sets), np.repeat(np.arange(k), lengths)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    edges = np.flatnonzero(np.r_[True, joined[1:] != joined[:-1], True])
    held = np.diff(edges)
    column, count = np.repeat(np.arange(len(held)), held), np.repeat(held, held)
    both = np.zeros((k, k), np.int64)
    few = (count > 1) & (count <= 32)
    col, own = column[few], owner[few]
    for step in range(1, int(count[few].max(initial=1))):
        at = np.flatnonzero(col[:-step] == col[step:])
        np.add.at(both, (own[at], own[at + step]), 1)
    both += both.T
    many = count > 32
    if many.any():
        col = np.unique(column[many], return_inverse=True)[1]
        own = owner[many]
        for low in range(0, int(col.max()) + 1, 4096):
            at = (col >= low) & (col < low + 4096)
            present = np.zeros((k, 4096), np.float32)
            present[own[at], col[at] - low] = 1
            both += (present @ present.T).astype(np.int64)
    linked = 100 * both >= percent * (lengths[:, None] + lengths[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(k)
    while True:
        least = np.where(linked, label[None, :], k).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _sets_of_nodes(frames: Iterator) -> Iterator:
    import pandas as pd
    import xxhash

    for frame in frames:
        rows = []
        for text, node, root in zip(frame["text"], frame["node"], frame["root"], strict=True):
            found = shingle_set(text).tobytes()
            if xxhash.xxh3_128_digest(found) == bytes(node):
                rows.append((node, root, found))
        yield pd.DataFrame(rows, columns=["node", "root", "hashes"])


def _similar_in_blocks(percent: int) -> Callable[[Iterator], Iterator]:
    def work(frames):
        import numpy as np
        import pandas as pd

        for frame in _runs((f for f in frames if len(f)), "block"):
            keys = frame["block"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
            out = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                nodes = dict(zip(frame["node"].iloc[low:high], frame["hashes"].iloc[low:high], strict=True))
                if len(nodes) > 1:
                    names = list(nodes)
                    label = similar_sets([np.frombuffer(h, np.uint64) for h in nodes.values()], percent)
                    out += ((n, names[j]) for i, (n, j) in enumerate(zip(names, label, strict=True)) if i != j)
            yield pd.DataFrame(out, columns=["a", "b"])

    return work


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    Two texts are linked when ``100 * common >= percent * united`` of their shingle sets; a
    component's id is its smallest key. A null text or one without words is linked with nothing.
    Rows with equal texts are linked whatever their keys, repeated rows included; a null key takes
    part but never names a component unless all its keys are null. An empty table gives no rows.
    Other columns are ignored.
    """
    chunks = chunks_for(percent / 100)
    rows = materialize(signed(docs, key, text, chunks), "signed")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("key").alias("first_key"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")
    )
    nodes = materialize(nodes, "nodes")
    pools = near_pools(nodes, chunks)
    inside = pools.join(nodes.select("node", "first_key", "n_shingles"), "node")
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = texts.join(inside, texts["key"].eqNullSafe(inside["first_key"])).select("text", "node", "root")
    sets = found.mapInPandas(_sets_of_nodes, "node binary, root binary, hashes binary")
    parts = inside.groupBy("root").agg(
        F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count("*") / BLOCK_NODES)).cast("int").alias("parts")
    )
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = sets.join(parts, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("node", "hashes", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("block"))
    # A block that meets itself only is needed where the pool has one block.
    links = dealt.repartition("block").sortWithinPartitions("block").mapInPandas(_similar_in_blocks(percent), "a binary, b binary")
    joined = components(links)
    least = joined.join(nodes.select("node", "first_key"), "node").groupBy("root").agg(F.min("first_key").alias("least_key"))
    labels = nodes.select("node", "first_key").join(joined.join(least, "root").select("node", "least_key"), "node", "left")
    labels = labels.select("node", F.coalesce("least_key", "first_key").alias("component_id"))
    out = rows.select("key", "n_shingles", "node").join(labels, "node", "left")
    return out.select(
        F.col("key").alias(key),
        "n_shingles",
        F.coalesce("component_id", "key").alias("component_id"),
        F.coalesce(F.col("key") == F.coalesce("component_id", "key"), F.lit(False)).alias("kept"),
    )
