"""Archives, chats, vectors, mixing, shards, packing and the pipeline against brute force, with odd rows."""

import base64
import collections
import datetime
import decimal
import hashlib
import math
import random
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import numpy as np

from terralume.llm import packing, warc
from terralume.llm.chat import digests, formatted
from terralume.llm.embeddings import near_vectors
from terralume.llm.mixing import mixed, sampled
from terralume.llm.wavelet import WaveletMatrix, open_shard, read_shards, shard_bytes, write_shards

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BIG = 2**60 + 1


def test_archives_come_back(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 40}</p>" * (i % 7 + 1), "x") for i in range(300)]
    rows += [(BIG, None, None, "x"), (1000, "bad url\r\nX: y", "", "x"), (1001, "u", "é" * 50_000, "x"), (None, "n", "<p>null key</p>", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    archives = warc.write_archives(table)
    got = collections.Counter(tuple(r)[:1] + tuple(r)[2:] for r in warc.read_archives(archives).collect())
    first = {}
    for page, _, html, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", page)
    wanted = collections.Counter()
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = page is not None and first[html or ""] != page
        wanted[(page, len(data), digest, "revisit" if again else "response", first[html or ""] if again else None)] += 1
    assert got == wanted
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_each_record_is_a_frame_behind_the_dictionary():
    records = [warc.record_bytes(i, f"u{i}", b"<html>body %d</html>" % i * 20, "00" * 20, None) for i in range(200)]
    for part in (records, records[:1]):
        parts = list(warc.archive_bytes(part))
        assert len(parts) == len(part) + 1 and int.from_bytes(parts[0][:4], "little") == warc.SKIPPABLE
        assert all(p[:4] == b"\x28\xb5\x2f\xfd" for p in parts[1:])
        assert [f["WARC-Target-URI"] for f, _ in warc.read_archive(b"".join(parts))] == [f"u{i}" for i in range(len(part))]
    assert sum(map(len, warc.archive_bytes(records))) < sum(map(len, records)) / 3


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_come_back(spark):
    rng = random.Random(4)
    parts = ["<|im_end|>", "<\\|im_end|>", "<", "|", "\\", "</s>", "[INST]", "[/INST]", "[\\INST]", "<|im_sep|>", "<|im_start|>user\n", "\n", "é", "a ", ""]
    roles = ["user", "assistant", "system", None, "a\\nb\nc<|im_sep|>"]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), "".join(rng.choice(parts) for _ in range(6))) for c in range(60) for t in range(c % 9 + 1)]
    rows += [(100, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (101, None, "assistant", "first"), (101, 0, "user", "z")]
    rows += [(102, 0, "user", "same")] * 3 + [(103, i, "assistant", f"turn {i} </s>") for i in range(400)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    held = collections.defaultdict(list)
    for c, t, r, x in rows:
        held[c].append((-1 if t is None else t, r or "", x or ""))
    chats = formatted(table)
    for row in digests(chats).collect():
        turns = [(r, x) for _, r, x in sorted(held[row.conv_id])]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns))), turns
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss)), turns
    assert chats.count() == len(held)
    merged = chats.where("conv_id = 103").first()
    assert merged.n_blocks == 1 and merged.formatted.count("<|im_start|>") == 1
    assert formatted(table.limit(0)).count() == 0


def test_chats_of_many_turns(spark):
    """More runs than one slice sums, with characters of one to four bytes."""
    texts = ["", "a</s>", "ü[INST]", "€", "\U0001d11e|" * 3]
    turns = [(1, t, "assistant" if t % 3 else "user", texts[t % 5] * (t % 7)) for t in range(700)]
    row = digests(formatted(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))).first()
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (700, len(loss), sha(loss))


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    near = base[:60] + 0.08 * rng.normal(size=(60, 16))
    chain = [base[0] + k * 0.12 * base[1] for k in range(12)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, *chain, base[5], 3 * base[5]])]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])] + [(10_000, [1e300] * 16), (10_001, [1e-300] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {k: np.array(v) / np.abs(v).max() for k, v in rows if k is not None and (k < n or k >= 10_000 or k == n + 6)}
    unit = {k: v / np.linalg.norm(v) for k, v in good.items()}
    keys = sorted(unit)
    linked = {k: {o for o in keys if o != k and len(unit[o]) == len(unit[k]) and unit[o] @ unit[k] >= 0.95} for k in keys}
    component = {k: k for k, _ in rows if k is not None}
    changed = True
    while changed:
        changed = False
        for k in keys:
            least = min([component[k], *(component[o] for o in linked[k])])
            changed |= least != component[k]
            component[k] = least
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    assert len(got) == len(rows)
    for k, c in component.items():
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (len(linked.get(k, ())), c, c == k), k
    assert got[None].kept is False
    assert near_vectors(table.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "b", "c", "c", "c", "c", "é", None])) for i in range(4000)]
    rows += [(None, None, "a"), (5000, "", "empty"), (1, "one two", "tiny"), (1, "one two", "tiny")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "size")
    got = mixed(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(table).collect()), key=str)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        each = rest / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and each * weight[s] > 3 * sizes[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * sizes[s] if s in full else each * weight[s] for s in order}
    taken = collections.Counter()
    for r in got:
        assert r._size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r._size
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 130
    assert len(got) == len(rows) and sampled(table).count() == sum(r.copies for r in got)
    assert mixed(table.limit(0)).count() == 0


def test_wavelet_matrix_answers():
    rng = random.Random(8)
    for size in (0, 1, 511, 512, 513, 3000):
        values = [rng.choice([0, 1, 2, 40_000, 65_535, rng.randrange(65_536)]) for _ in range(size)]
        matrix = WaveletMatrix.build(np.array(values, "<u2"), 16)
        assert matrix.size == size and matrix.values().tolist() == values
        for _ in range(60 if size else 0):
            at, token = rng.randrange(size), rng.choice(values + [77])
            low = rng.randrange(size)
            high = rng.randint(low, size)
            places = [i for i, v in enumerate(values) if v == token]
            nth = rng.randrange(len(places) + 1)
            assert matrix.access(at) == values[at]
            assert matrix.count(token, low, high) == values[low:high].count(token)
            assert matrix.occurrence(token, nth) == (places[nth] if nth < len(places) else -1)


def test_wide_ids_and_odd_keys(spark, tmp_path):
    values = np.array([0, 70_000, 131_071, 5] * 400, "<u4")
    keys, lengths, matrix = open_shard(shard_bytes([datetime.date(2020, 1, 1), None], [900, 700], values.tobytes(), 17))
    assert keys.to_pylist() == [datetime.date(2020, 1, 1), None] and lengths.tolist() == [900, 700]
    assert matrix.values().tolist() == values.tolist() and matrix.count(70_000) == 400
    with pytest.raises(ValueError):
        shard_bytes([1], [1600], values.tobytes(), 16)
    for kind, first, second in (("decimal(30,2)", "1.50", "-2.25"), ("binary", b"\xff\x00", b"\x01"), ("date", datetime.date(2020, 1, 2), None)):
        first, second = (decimal.Decimal(x) if kind[:3] == "dec" else x for x in (first, second))
        table = spark.createDataFrame([(first, "one text"), (second, None)], f"key {kind}, text string")
        got = {r["key"]: r["n_tokens"] for r in read_shards(write_shards(table, BYTE_BPE, key="key"), kind).collect()}
        assert {k if kind != "binary" else bytes(k): n for k, n in got.items()} == {first: 3, second: 1}


def library_ids(text):
    from tokenizers import Tokenizer

    library = library_ids.__dict__.setdefault("library", Tokenizer.from_file(BYTE_BPE))
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def texts():
    rng = random.Random(9)
    words = ["alpha", "Beta,", "gamma.", "\nDelta", "12", "é", "x" * 200]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 300, 2500])))) for i in range(60)]
    return [*rows, (BIG, ""), (70, None), (None, "null key"), (5, rows[5][1])]


def test_shards_come_back(spark):
    table = spark.createDataFrame([(k, t, 1) for k, t in texts()], "doc_id long, text string, start int")
    got = read_shards(write_shards(table, BYTE_BPE)).orderBy("start").collect()
    assert [r.key for r in got] == sorted((k for k, _ in texts()), key=lambda k: (k is not None, k))
    at = 0
    wanted = collections.Counter((k, library_ids(t).tobytes()) for k, t in texts())
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert collections.Counter((r.key, bytes(r.ids)) for r in got) == wanted
    assert read_shards(write_shards(table.limit(0), BYTE_BPE)).count() == 0


def test_packing_is_whole_and_tight(spark):
    table = spark.createDataFrame([(k, t, "c") for k, t in texts()], "doc_id long, text string, offset string")
    got = packing.packed_documents(table, BYTE_BPE).collect()
    pieces = collections.Counter()
    for key, text in texts():
        ids = library_ids(text)
        first = (len(ids) - 1) % 2048 + 1
        for n, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048))):
            pieces[(key, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == pieces
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(held) <= math.ceil(total / 2048) + 3
    assert packing.packed_documents(table.limit(0), BYTE_BPE).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 5000):
        lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6.3, 1, n).astype(int)))
        counts = np.bincount(lengths, minlength=2049)
        plan = packing.plan_sequences(counts)
        again = np.zeros(2049, int)
        for config, copies in plan:
            assert sum(config) <= 2048
            for x in config:
                again[x] += copies
        assert (again == counts).all()
        assert sum(c for _, c in plan) <= math.ceil(lengths.sum() / 2048) * 1.01 + 3
    assert packing.plan_sequences(np.zeros(2049, int)) == []


def histogram(lengths):
    return np.bincount(lengths, minlength=2049)


def test_plan_follows_the_dual_prices():
    """Where waste can't be avoided, the plan is near the number that its prices prove."""
    rng = np.random.default_rng(1)
    cases = {
        "five": (histogram(np.repeat([1030, 700, 690, 515, 400], [900, 1800, 1700, 1500, 1600])), 1.01),
        "halves": (histogram(np.r_[rng.integers(1025, 1100, 2000), rng.integers(300, 700, 3000)]), 1.01),
        "thirds": (histogram(np.r_[rng.integers(683, 720, 4000), rng.integers(500, 683, 2000)]), 1.01),
        "quarters": (histogram(np.r_[rng.integers(513, 530, 5000), rng.integers(100, 400, 3000)]), 1.01),
        "between a fifth and a third": (histogram(rng.integers(410, 641, 9000)), 1.03),
    }
    for name, (counts, factor) in cases.items():
        plan, bound = packing.planned(counts)
        made = sum(copies for _, copies in plan)
        held = np.zeros(2049, int)
        for config, copies in plan:
            assert sum(config) <= 2048
            np.add.at(held, list(config), copies)
        assert (held == counts).all(), name
        assert made >= bound - 1e-6 and made <= bound * factor + 3, (name, made, bound)
        assert made <= sum(copies for _, copies in packing.best_fit(counts)), name


def test_bound_is_below_the_optimum_of_small_histograms():
    """Against all packings of few pieces into sequences of ten."""
    rng = np.random.default_rng(5)

    def fewest(pieces):
        full = (1 << len(pieces)) - 1
        size = [sum(p for i, p in enumerate(pieces) if m >> i & 1) for m in range(full + 1)]
        best = [0] + [99] * full
        for mask in range(1, full + 1):
            part = mask
            while part:
                if size[part] <= 10:
                    best[mask] = min(best[mask], best[mask ^ part] + 1)
                part = (part - 1) & mask
        return best[full]

    for _ in range(20):
        pieces = rng.integers(1, 11, 8).tolist()
        plan, bound = packing.planned(np.bincount(pieces, minlength=11))
        made = sum(copies for _, copies in plan)
        assert bound - 1e-9 <= fewest(pieces) <= made <= fewest(pieces) + 1


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(20)).capitalize() + "." for _ in range(6))
    clean = [prose() for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s0", 1), (101, clean[1] + " tail.", "en", None, None), (102, "short", "en", "s1", 5), (103, None, None, None, None)]
    rows += [(104, "$$$ ### " * 60, "en", "s1", 5), (105, clean[2][:-1] + " +1 (171) 555-2028.", "en", "s2", 9), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "personal_data", "mixing", "packing"]
    kept = stages["quality"](spark, docs, "").cache()
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(30), 100, 101, 105}
    alone = stages["near_dedup"](spark, kept, "").cache()
    assert sorted(r.doc_id for r in alone.collect()) == list(range(30))
    masked = stages["personal_data"](spark, docs.where("doc_id = 105"), "").first()
    assert masked.text.endswith("[PHONE].") and masked.n_chars == len(masked.text)
    mix = stages["mixing"](spark, alone, "")
    assert mix.columns == docs.columns and mix.count() > 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns) and packed.count() == mix.count()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
