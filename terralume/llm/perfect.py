"""A minimal perfect hash of integer keys, built segment by segment.

Keys are dealt to segments by a hash. Within a segment, level after level, a key takes a bit of
the level's bit array if no other key wants it, and goes on to the next level otherwise. The slot
of a key is the number of ones before its bit, over all levels and segments, so slots run from 0
without gaps. The keys themselves, in order of slots, tell keys of the table from others.
"""

from __future__ import annotations

ROOM = 2  # bits of a level for each key that reaches it
LEVELS = 64  # distinct keys never need so many; more means a repeated key


def mixed(keys, seed: int):
    """64 well-mixed bits of each key: a bijection for each seed."""
    import numpy as np

    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def segment_of(keys, segments: int):
    import numpy as np

    return (mixed(keys, LEVELS) % np.uint64(segments)).astype(np.int64)


def build_segment(keys) -> tuple[list[int], bytes, bytes]:
    """Bits of each level, the levels' bits, and the keys in order of their slots."""
    import numpy as np

    rest = keys.astype(np.uint64)
    sizes, bits, order = [], [], []
    while len(rest):
        if len(sizes) == LEVELS:
            raise ValueError("keys of a perfect hash must be distinct")
        size = -(-ROOM * len(rest) // 64) * 64
        at = (mixed(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
        wanted = np.bincount(at, minlength=size)
        alone = wanted[at] == 1
        sizes.append(size)
        bits.append(np.packbits(wanted == 1, bitorder="little"))
        order.append(rest[alone][np.argsort(at[alone])])
        rest = rest[~alone]
    join = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes() if parts else b""
    return sizes, join(bits, np.uint8), join(order, "<u8")


class PerfectHash:
    """Slots of keys, from the segments in their order."""

    def __init__(self, segments: list[tuple[list[int], bytes, bytes]]):
        import numpy as np

        self.segments = len(segments)
        depth = max((len(s[0]) for s in segments), default=0)
        self.sizes = np.zeros((depth, max(1, self.segments)), np.uint64)
        self.starts = np.zeros_like(self.sizes, np.int64)
        at = 0
        for k, (sizes, _, _) in enumerate(segments):
            for level, size in enumerate(sizes):
                self.sizes[level, k], self.starts[level, k] = size, at
                at += size
        self.words = np.frombuffer(b"".join(s[1] for s in segments), "<u8")
        self.ahead = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.frombuffer(b"".join(s[2] for s in segments), "<u8")

    def slots(self, keys):
        """The slot of each key, -1 for keys that are not in the table."""
        import numpy as np

        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        keys = keys.astype(np.uint64)
        segment = segment_of(keys, self.segments)
        open_ = np.arange(len(keys))
        for level in range(len(self.sizes)):
            size = self.sizes[level][segment]
            there = size > 0
            if not there.all():
                open_, segment, size = open_[there], segment[there], size[there]
            at = self.starts[level][segment] + (mixed(keys[open_], level) % size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            found[open_[hit]] = self.ahead[at[hit] >> 6] + below
            open_, segment = open_[~hit], segment[~hit]
            if not len(open_):
                break
        right = found >= 0
        right[right] = self.keys[found[right]] == keys[right]
        return np.where(right, found, -1)
