"""Near-duplicate vectors: an exact metric range join over pivot cells.

On unit vectors a cosine of at least ``c`` is a distance of at most ``r = sqrt(2 - 2c)``. Each vector
belongs to the cell of its nearest pivot. By the triangle inequality a partner of ``x`` can lie in
the cell of pivot ``j`` only if ``x`` is within ``r`` of the plane between its own pivot and ``j``; only then
``x`` is copied there. A pair of cells meets in the lower one alone. Cells are joined
independently: members with members and with copies. A large cell is dealt to blocks first, so no
task holds more than two blocks. Blocks give counts and spanning links, not pairs.

Pivots are a bounded sample and only decide how much work there is; results don't depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralume.session import materialize

from .components import components

COSINE = 0.95
PIVOTS = 256  # most pivots; they travel to every task
SAMPLE = 2_000  # vectors that pivots are chosen from
BLOCK = 8_192  # vectors of a block of a cell
SLACK = 1e-6  # added to distances where rounding could lose a copy


def choose_pivots(sample, most: int = PIVOTS):
    """Vectors of a sample that lie far from each other: each next is the farthest from those before."""
    import numpy as np

    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(most, len(sample)):
        nxt = int(np.argmin(near))
        if near[nxt] > 1 - 1e-9:
            break
        chosen.append(nxt)
        near = np.maximum(near, sample @ sample[nxt])
    return sample[chosen]


def unit_rows(vectors):
    """Unit vectors in double precision and the rows that have one; null, empty, zero and non-finite ones don't."""
    import numpy as np

    out, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or len(v) == 0:
            continue
        a = np.array([np.nan if x is None else x for x in v] if getattr(v, "dtype", None) == object else v, np.float64)
        if not np.isfinite(a).all() or not a.any():
            continue
        a = a / np.abs(a).max()  # neither overflow nor underflow in the norm
        out.append(a / np.sqrt((a * a).sum()))
        rows.append(i)
    return out, rows


def _to_units(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        units, rows = unit_rows(batch.column(1).to_pandas())
        columns = [
            batch.column(0).take(pa.array(rows, pa.int32())),
            pa.array([len(u) for u in units], pa.int32()),
            pa.array([u.astype("<f8").tobytes() for u in units], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "dims", "unit"])


def _to_cells(pivots: dict, radius: float):
    """Each vector with its own cell and the lower cells that can hold partners of it."""

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            parts = []
            for dims, part in frame.groupby("dims"):
                x = np.frombuffer(b"".join(part["unit"]), "<f8").reshape(len(part), dims)
                p = pivots[dims]
                cosine = np.clip(x @ p.T, -1, 1)
                home = cosine.argmax(1)
                mine = cosine[np.arange(len(x)), home]
                apart = np.sqrt(np.maximum(2 - 2 * np.clip(p @ p.T, -1, 1), 1e-18))
                # Distance to the plane between the own pivot and pivot j.
                plane = (mine[:, None] - cosine) / apart[home]
                copied = (plane <= radius + SLACK) & (np.arange(len(p))[None, :] < home[:, None])
                copied[np.arange(len(x)), home] = True
                at, cell = np.nonzero(copied)
                made = part[["key", "dims", "copies", "unit"]].iloc[at].reset_index(drop=True)
                made["cell"], made["home"] = cell.astype("int32"), cell == home[at]
                parts.append(made)
            if parts:
                yield pd.concat(parts)[["key", "dims", "copies", "unit", "cell", "home"]]

    return work


def _join_block(cosine: float):
    """Counts of links and spanning links of one block pair of a cell."""

    def work(frame):
        import numpy as np
        import pandas as pd

        dims = int(frame["dims"].iloc[0])
        same = bool(frame["same"].iloc[0])
        x = np.frombuffer(b"".join(frame["unit"]), "<f8").reshape(len(frame), dims)
        keys, copies = frame["key"].to_numpy(), frame["copies"].to_numpy(np.int64)
        left = np.flatnonzero(frame["left"].to_numpy())
        right = left if same else np.flatnonzero(~frame["left"].to_numpy())
        counts = np.zeros(len(x), np.int64)
        label, links = np.arange(len(x)), []
        for low in range(0, len(left), 256):
            rows = left[low : low + 256]
            near = x[rows] @ x[right].T >= cosine
            if same:
                near &= rows[:, None] != right[None, :]
            counts[rows] += near @ copies[right]
            if not same:
                counts[right] += near.T @ copies[rows]
            for i in np.flatnonzero(near.any(1)):
                with_i = right[near[i]]
                found = np.unique(label[with_i])
                new = found[found != label[rows[i]]]
                if len(new):
                    # One partner from each part that was not yet linked.
                    firsts = with_i[[int(np.argmax(label[with_i] == f)) for f in new]]
                    links += [(keys[rows[i]], keys[j]) for j in firsts]
                    label[np.isin(label, new)] = label[rows[i]]
        seen = np.flatnonzero(counts)
        made = [pd.DataFrame({"a": keys[seen], "b": keys[seen], "n": counts[seen]})]
        if links:
            a, b = zip(*links, strict=True)
            made.append(pd.DataFrame({"a": a, "b": b, "n": 0}))
        return pd.concat(made)

    return work


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept`` for every row of ``rows``.

    Vectors of equal length with a cosine (double precision) of at least ``cosine`` are linked. Null, empty
    and zero vectors and those with null or non-finite components are linked with nothing. Equal
    vectors are found first and counted, not compared. A component's id is its smallest key; rows with
    a null key get none and name none. Repeated rows count as links to each other. An empty table
    gives no rows.
    """
    import numpy as np

    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    units = materialize(plain.mapInArrow(_to_units, f"key {kind}, dims int, unit binary"), "units")
    # One representative of equal unit vectors; ``key`` is the smallest of the group.
    groups = units.where("key is not null").groupBy("dims", "unit").agg(F.min("key").alias("key"), F.count("*").alias("copies"))
    groups = materialize(groups, "vectors")

    pivots = {}
    for dims, n in groups.groupBy("dims").count().collect():  # a row per vector length
        sample = groups.where(F.col("dims") == dims).orderBy(F.xxhash64("unit")).limit(SAMPLE).select("unit").collect()
        unit = np.frombuffer(b"".join(bytes(r[0]) for r in sample), "<f8").reshape(-1, dims)
        pivots[dims] = choose_pivots(unit, min(PIVOTS, 2 * -(-n // BLOCK)))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    schema = f"key {kind}, dims int, copies long, unit binary, cell int, home boolean"
    celled = materialize(groups.select("key", "dims", "copies", "unit").mapInPandas(_to_cells(pivots, radius), schema), "cells")

    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    parts = celled.groupBy("dims", "cell").agg(
        blocks(F.count_if("home")).alias("members"), F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("guests")
    )
    dealt = celled.join(parts, ["dims", "cell"])
    own = F.pmod(F.xxhash64("key"), F.when(F.col("home"), F.col("members")).otherwise(F.col("guests"))).cast("int")
    dealt = dealt.withColumn("own", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda guests, a, b, left: F.struct(guests.alias("guest"), a.alias("low"), b.alias("high"), left.alias("left"))
    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    with_members = F.transform(upto(F.col("members")), lambda i: pair(no, F.least(own, i), F.greatest(own, i), own <= i))
    with_guests = F.transform(upto(F.col("guests")), lambda i: pair(yes, own, i, yes))
    as_guest = F.transform(upto(F.col("members")), lambda i: pair(yes, i, own, no))
    meets = F.when(F.col("home"), F.concat(with_members, with_guests)).otherwise(as_guest)
    dealt = dealt.select("key", "dims", "copies", "unit", "cell", F.explode(meets).alias("at")).select(
        "key", "dims", "copies", "unit", "cell", "at.*", (~F.col("at.guest") & (F.col("at.low") == F.col("at.high"))).alias("same")
    )
    met = dealt.groupBy("dims", "cell", "guest", "low", "high")
    found = materialize(met.applyInPandas(_join_block(cosine), f"a {kind}, b {kind}, n long"), "found")

    links = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    reps = groups.select("dims", "unit", F.col("key").alias("rep"), "copies")
    reps = reps.join(counts, "rep", "left").join(links, F.col("rep") == F.col("node"), "left")
    reps = reps.select(
        "dims", "unit", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    )
    of_key = units.where("key is not null").join(reps, ["dims", "unit"]).groupBy("key").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    out = plain.select("key").join(of_key, "key", "left")
    component = F.coalesce("component_id", "key")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
