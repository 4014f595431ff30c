"""Packing of token pieces into sequences by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence. The program asks for the fewest
sequences whose configurations hold the histogram of lengths. It has a row per length (at most
``length`` of them, whatever the corpus) and is solved by multiplicative weights: lengths that are
behind gain price, and a knapsack over the capacity finds the best configuration at these dual
prices, which also prove how many sequences are needed at least. The solution is rounded down,
the program is solved again for what is left, and the last remainder is put into the sequences
with least space left. Only the histogram reaches the driver; pieces find their place by their
rank among those of equal length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralume.session import materialize

from .tokens import batches, encoder

LENGTH = 2048
KEPT_PIECES = 200_000  # pieces a worker keeps: in the pipeline it also holds what other stages keep
ROUNDS = 4  # times the program is solved, each time for what rounding has left
STEPS = 40  # price updates in a round
RATE = 0.3  # how fast the price of a length that is behind grows
STEPPED = 19  # stepped prices tried at the start, up to pieces just over a twentieth
FILL = 0.02  # part of a starting price that is the share of a sequence
LONG_FIRST = 0.0015  # how much more a length is worth that fills a sequence
RANK_CELLS = 1024  # cells that pieces of equal length are dealt to for ranking


class Slots(NamedTuple):
    """Columns of places: pieces of a length with ranks from ``start`` go to sequences from ``sequence``."""

    length: object
    start: object
    sequence: object
    offset: object


def cut_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit) for each piece.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone.
    Only documents longer than ``length`` are cut: the last pieces are full, the first takes the
    rest. Repeated rows and null keys are cut as any others.
    """

    def work(frames: Iterator) -> Iterator:
        import pyarrow as pa

        end = end_id.to_bytes(4, "little")
        for frame in frames:
            texts = frame.column(1).to_pylist()
            for low, high in batches(texts):
                rows = []
                for i, ids in enumerate(encoder(path, kept=KEPT_PIECES).batch(texts[low:high]), low):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                    rows += [(i, piece, a, b - a, ids[4 * a : 4 * b]) for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                at, *made = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))
                yield pa.RecordBatch.from_arrays([frame.column(0).take(at), *made], names=["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


def best_fill(value, capacity: int):
    """Knapsack: the best worth and the length to take first (0 for none) of each capacity.

    ``value[l]`` is the worth of length ``l``; what is not above zero is never taken.
    """
    import numpy as np

    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(value > 0)
    if (capacity / np.maximum(lengths, 1)).sum() < capacity // 2:  # few lengths: block after block of each
        for length in lengths.tolist():
            for low in range(length, capacity + 1, length):
                high = min(low + length, capacity + 1)
                total = best[low - length : high - length] + value[length]
                better = total > best[low:high]
                best[low:high][better], first[low:high][better] = total[better], length
        return best, first
    worth = value[1:]
    for room in range(1, capacity + 1):
        total = worth[:room] + best[room - 1 :: -1] if room > 1 else worth[:1]
        k = int(np.argmax(total))
        if total[k] > 0:
            best[room], first[room] = total[k], k + 1
    return best, first


def start_prices(counts, capacity: int):
    """Dual prices to start from and the bound they prove: the best of some known feasible ones.

    A length is worth its share of a sequence, or ``floor((k + 1) * share) / k``, which is right where
    pieces lie just over a half, a third and so on. Any prices prove that at least their sum over all
    pieces, divided by the worth of the best configuration, sequences are needed.
    """
    import numpy as np

    lengths = np.arange(capacity + 1)
    share = lengths / capacity
    found = [(proved(counts, share, capacity), share)]
    for k in range(1, STEPPED + 1):
        steps = (k + 1) * lengths
        prices = np.where(steps % capacity == 0, share, steps // capacity / k)
        found.append((proved(counts, prices, capacity), prices))
    bound, prices = max(found, key=lambda x: x[0])
    return prices, bound


def proved(counts, prices, capacity: int) -> float:
    """Least number of sequences that ``prices`` prove for ``counts`` (index 0 unused)."""
    import numpy as np

    best, _ = best_fill(np.where(counts > 0, prices, 0.0), capacity)
    return float((counts * prices).sum() / best[capacity]) if best[capacity] > 0 else 0.0


def solve(counts, capacity: int) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional solution, as sequences of each configuration that hold ``counts``, and a proved bound.

    In each step every length shall get on by an equal share. The dual price of a length that is behind
    grows, that of one ahead falls, by a factor of its distance from the mean; one knapsack over the
    prices finds the best fill of every capacity, and with it the best configuration that holds a given
    length. Each length still behind takes its own. The prices of each step prove a bound; the best is kept.
    """
    import numpy as np

    plan: dict[tuple[int, ...], float] = {}
    left = counts.astype(float)
    lengths = np.flatnonzero(counts)
    base, bound = start_prices(counts, capacity)
    share = np.arange(capacity + 1) / capacity
    # Room that is worth nothing is filled all the same, and among equals the long pieces come first.
    base = ((1 - FILL) * base + FILL * share) * (1 + LONG_FIRST * share)
    weight = np.zeros(capacity + 1)
    for step in range(STEPS):
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_):
            break
        prices = base * np.exp(weight)
        worth = np.zeros(capacity + 1)
        worth[open_] = prices[open_]
        best, first = best_fill(worth, capacity)
        if len(open_) == len(lengths):
            bound = max(bound, float((counts * prices).sum() / best[capacity]))
        fills = first.tolist()
        goal = counts * (1 - (step + 1) / STEPS)
        for length in open_[::-1].tolist():
            lack = left[length] - goal[length]
            if lack <= 1e-9:
                continue
            config, room = [length], capacity - length
            while fills[room]:
                config.append(fills[room])
                room -= config[-1]
            times = Counter(config)
            amount = min(lack / times[length], *(left[x] / n for x, n in times.items()))
            if amount > 1e-9:
                for x, n in times.items():
                    left[x] -= n * amount
                name = tuple(config)
                plan[name] = plan.get(name, 0.0) + amount
        behind = left[lengths] / counts[lengths]
        worths = counts[lengths] * prices[lengths]
        weight[lengths] = np.clip(weight[lengths] + RATE * (behind - (behind * worths).sum() / worths.sum()), -2, 2)
    return plan, bound


def best_fit(counts) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and copies that take ``counts``: longest first, each where least space stays."""
    import bisect

    capacity = len(counts) - 1
    rooms: list[int] = []
    held: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, config: tuple[int, ...], copies: int) -> None:
        if room not in held:
            bisect.insort(rooms, room)
        held.setdefault(room, []).append((config, copies))

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n // each:
                    put(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    put(capacity - n % each * length, (length,) * (n % each), 1)
                break
            room = rooms[at]
            config, copies = held[room].pop()
            if not held[room]:
                del held[room], rooms[at]
            used = min(n, copies)
            if used < copies:
                put(room, config, copies - used)
            put(room - length, (*config, length), used)
            n -= used
    return [x for found in held.values() for x in found]


def plan_sequences(counts) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and copies whose places are exactly ``counts[length]`` (index 0 unused)."""
    return planned(counts)[0]


def planned(counts) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """The plan, and the number of sequences that no plan can go below.

    The program is solved and rounded down, again for what is left, and best fit takes the remainder.
    Should rounding cost more than it gains, best fit alone is the plan.
    """
    import numpy as np

    capacity = len(counts) - 1
    left = np.array(counts, np.int64)
    chosen: dict[tuple[int, ...], int] = {}
    bound = 0.0

    def take(config: tuple[int, ...], copies: int) -> None:
        times = Counter(config)
        copies = min([copies, *(left[x] // n for x, n in times.items())])
        if copies > 0:
            chosen[config] = chosen.get(config, 0) + int(copies)
            for x, n in times.items():
                left[x] -= n * copies

    for _ in range(ROUNDS):
        if not left.any():
            break
        solution, proof = solve(left, capacity)
        bound = bound or proof  # later rounds see what is left
        ordered = sorted(solution.items(), key=lambda x: (-int(x[1]), capacity - sum(x[0]), x[0]))
        for config, amount in ordered:
            take(config, int(amount + 1e-6))
        for config, amount in sorted(ordered, reverse=True):  # a full one loses nothing when rounded up
            if sum(config) == capacity and amount % 1 > 1e-6:
                take(config, 1)
    for config, copies in best_fit(left):
        chosen[config] = chosen.get(config, 0) + copies
    plain: dict[tuple[int, ...], int] = {}
    for config, copies in best_fit(counts):
        plain[config] = plain.get(config, 0) + copies
    return sorted(min(chosen, plain, key=lambda x: sum(x.values())).items()), bound


def slots(plan: list[tuple[tuple[int, ...], int]]) -> Slots:
    """The plan as sorted columns; a configuration with a length twice has two places for it."""
    import numpy as np

    rows, used, sequence = [], {}, 0
    for config, copies in plan:
        offset = 0
        for length in config:
            start = used.get(length, 0)
            used[length] = start + copies
            rows.append((length, start, sequence, offset))
            offset += length
        sequence += copies
    rows.sort()
    return Slots(*np.array(rows, np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), length: int = LENGTH) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; each piece lies whole in one sequence, without gaps.

    ``pieces`` has a long column ``length`` from 1 to ``length``; its other columns stay. ``keys`` only make
    the order among equal lengths stable. The plan that every task gets has at most a few entries for
    each length, whatever the number of pieces.
    """
    pieces = materialize(pieces, "pieces")
    import numpy as np

    counts = np.zeros(length + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``length`` rows
        counts[row["length"]] = row["count"]
    place = slots(plan_sequences(counts))
    begin = np.searchsorted(place.length, np.arange(length + 2))

    cell = F.pmod(F.xxhash64(*keys), F.lit(RANK_CELLS))
    dealt = pieces.withColumn("_cell", cell)
    sizes = dealt.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_cell").orderBy(*keys)
    ranked = dealt.withColumn("_row", F.row_number().over(inside)).join(bases, ["length", "_cell"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths, ranks):
        import pandas as pd

        # Starts within a length ascend; one key for both lets a single search find all.
        at = np.empty(len(lengths), np.int64)
        values, ranks = lengths.to_numpy(), ranks.to_numpy()
        for value in np.unique(values):
            these = values == value
            low, high = begin[value], begin[value + 1]
            at[these] = low + np.searchsorted(place.start[low:high], ranks[these], side="right") - 1
        return pd.DataFrame({"sequence_id": place.sequence[at] + ranks - place.start[at], "offset": place.offset[at]})

    found = ranked.withColumn("_place", placed(F.col("length"), F.col("_base") + F.col("_row") - 1))
    return found.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its ``ids``, ``sequence_id`` and ``offset``."""
    return pack(cut_pieces(docs, path, key, text, length, end_id), (key, "piece"), length)
