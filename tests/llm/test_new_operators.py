"""Token alignment, phrases and exact duplicates against brute force, with odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from terralume.llm import phrases
from terralume.llm.align import aligned, byte_level_bytes, most_pairs, pair_counts, piece_bytes
from terralume.llm.exact import deduplicated, exact_groups
from terralume.llm.perfect import PerfectHash, build_segment, segment_of
from terralume.llm.phrases import collocations

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "one", "one", "  two  blanks ", "a\nb\n\nc", "\n", "tab\tand\r\nreturn", "café naïve 中文 \U0001f600", "a▁b",
    "<|endoftext|> and </s><s>", "<0x41>", "x\x00y", "﻿bom", "ｆｕｌｌ", "é", "\x85 \xa0   wide", "word " * 30_000,
]


def prose(seed, count):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return ["".join(rng.choice(words).capitalize() + rng.choice([" ", " ", ", ", ".\n", "  "]) for _ in range(rng.randint(1, 200))) for _ in range(count)]


def ends(ids, table):
    at, out = 0, []
    for i in ids:
        at += len(table[i])
        out.append(at)
    return out


def test_alignment_matches_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    of_a, of_b = byte_level_bytes(A), piece_bytes(B)
    rows = [(k if k != 5 else None, t) for k, t in enumerate(ODD + prose(3, 40))] + [(1, "a repeated key")]
    sides, count = [], collections.Counter()
    for key, text in rows:
        a, b = [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if not b"".join(of_a[i] for i in a) == b"".join(of_b[i] for i in b) == b" " + text.encode():
                a, b = [], []
        links = [(i, j) for i, x in zip(a, ends(a, of_a)) for j, y in zip(b, ends(b, of_b)) if x == y] if len(a) < 2000 else None
        if links is None:
            at = dict(zip(ends(b, of_b), b))
            links = [(i, at[x]) for i, x in zip(a, ends(a, of_a)) if x in at]
        count.update(links)
        sides.append((key, a, b, links))
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    want = []
    for key, a, b, links in sides:
        cut_a, cut_b = ends(a, of_a), ends(b, of_b)
        both = sorted(set(cut_a) & set(cut_b))
        groups, low = [], 0
        for high in both:
            groups.append("|".join(",".join(str(i) for i, x in zip(s, c) if low < x <= high) for s, c in ((a, cut_a), (b, cut_b))))
            low = high
        want.append((key, len(a), len(b), len(both), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), ";".join(groups)))
    table = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, groups string").repartition(3)
    got = [tuple(r) for r in aligned(table, A, B).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(r[1] == 0 and t for r, (_, t) in zip(want, rows)), "a text that its tokens don't spell"
    found = {(r["a"], r["b"]): r["count"] for r in pair_counts(table, A, B).collect()}
    assert found == dict(count)
    assert len(count) <= most_pairs(of_a, of_b) < 2_000_000
    assert aligned(table.limit(0), A, B).count() == 0


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 30_000))
    for segments in (1, 7):
        table = PerfectHash([build_segment(keys[segment_of(keys, segments) == k]) for k in range(segments)])
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)
        assert (table.slots(others) == -1).all()
    assert PerfectHash([build_segment(keys[:0])]).slots(keys[:3]).tolist() == [-1, -1, -1]
    with pytest.raises(ValueError):
        build_segment(np.array([4, 4, 5]))


def by_hand(rows, support, longest, percent, most):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    out = []
    found = {(lang, w): a for (lang, w), a in count.items() if a >= support and len(w) > 1}
    absorbed = {
        (lang, w[i : i + k])
        for (lang, w), b in found.items()
        for k in range(2, len(w))
        for i in range(len(w) - k + 1)
        if 100 * b >= percent * count[lang, w[i : i + k]]
    }
    for (lang, w), a in found.items():
        if (lang, w) in absorbed:
            continue
        score, _, left, right = min((10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = collections.Counter()
    kept = []
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= most:
            kept.append((r[0], ranks[r[0]], *r[1:]))
    return kept


@pytest.mark.parametrize("support, longest, percent, most, shards", [(10, 3, 50, 2000, 4), (3, 4, 70, 25, 9), (2, 2, 50, 10, 1)])
def test_phrases_match_brute_force(spark, monkeypatch, support, longest, percent, most, shards):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 3000)  # several blocks a task
    rng = random.Random(11)
    words = ["Alpha", "beta", "äÄ", "z\xa0z", "x\x1cy"] + [f"w{i}" for i in range(25)]
    rows = [(t, lang) for t, lang in zip(ODD, [None, "und", "en", "", "a b"] * 9)]
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", " to be ", " in order to ", "? ", ";", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "en", None, "de"])))
    rows += [("the same row again and again", "en")] * 40
    table = spark.createDataFrame([(t, lang, k, 1) for k, (t, lang) in enumerate(rows)], "text string, lang string, h long, _part long")
    got = [tuple(r) for r in collocations(table.repartition(5), support=support, longest=longest, percent=percent, most=most, shards=shards).collect()]
    assert sorted(got) == sorted(by_hand(rows, support, longest, percent, most))
    assert collocations(table.limit(0)).count() == 0


def test_phrases_do_not_depend_on_the_filter(spark, monkeypatch):
    rows = [(t, "en") for t in prose(8, 60)]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(phrases, "FILTER_BYTES", 1)  # one segment for all hashes
    got = [tuple(r) for r in collocations(table, support=4).collect()]
    assert sorted(got) == sorted(by_hand(rows, 4, 3, 50, 2000))


def test_score_of_large_counts_is_exact(spark):
    rows = [("en", "a", 1, 10**15 - 1), ("en", "b", 1, 10**15 - 3), ("en", "a b", 2, 10**15 - 7)]
    row = phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, length int, count long")).first()
    assert row["score"] == 10**6 * (10**15 - 7) ** 2 // ((10**15 - 1) * (10**15 - 3))


def test_exact_groups_match_brute_force(spark):
    long = "long text " * 3000
    texts = ["a b", "a  b", "a\tb", "a b ", " a b", None, "", "\n", " ", "  ", "c d", "e f", long + "x", long + "y", long + " x", "café", "café", "a\xa0b"]
    rows = [(k, t) for k, t in enumerate(texts + prose(2, 20) + prose(2, 20))] + [(None, "a b"), (None, "only null"), (None, "only null"), (0, "a b"), (0, "else"), (11, "e f")]
    want, groups = [], collections.defaultdict(list)
    plain = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    for key, text in rows:
        groups[plain(text)].append(key)
    for key, text in rows:
        keys = [k for k in groups[plain(text)] if k is not None]
        least = min(keys) if keys else None
        want.append((key, least, len(groups[plain(text)]), key == least, hashlib.sha256(plain(text).encode()).hexdigest()))
    table = spark.createDataFrame([(k, t, "x", True) for k, t in rows], "doc_id long, text string, keep_id string, kept boolean").repartition(3)
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    got = [tuple(r) for r in exact_groups(table, hash_unique=True).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    lazy = {(r[0], r[1], r[2]): r[4] for r in exact_groups(table).collect()}
    assert None in lazy.values() and all(lazy[r[:3]] in (None, r[4]) for r in want)
    assert all(lazy[r[:3]] == r[4] for r in want if r[2] > 1)
    assert exact_groups(table.limit(0)).count() == 0
    left = deduplicated(table)
    assert left.columns == table.columns
    assert sorted(plain(r["text"]) for r in left.collect()) == sorted(groups)
