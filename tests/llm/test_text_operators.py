"""Near-duplicates, quality rules, personal data and counts against brute force, with odd rows."""

import collections
import random
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from terralume.llm import pii
from terralume.llm.bpe_counts import Counter, token_counts
from terralume.llm.minhash import chunks_for, near_duplicates
from terralume.llm.quality import judged, kept_rows
from terralume.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [f"w{i}" for i in range(400)]


def documents():
    """Prose with exact and near copies, short, blank, null and repeated rows, and a very long text."""
    rng = random.Random(7)
    rows, n = [], 0

    def add(text, key="next"):
        nonlocal n
        rows.append((n if key == "next" else key, text, "x"))
        n += 1

    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.randint(60, 160))]
        add(" ".join(base) + ".")
        for changes in (0, 1, 2, 4, 9):
            other = list(base)
            for _ in range(changes):
                other[rng.randrange(len(other))] = "changed"
            add(" ".join(other).upper() + "." if changes == 1 else " ".join(other) + ".")
    long = [rng.choice(VOCABULARY) for _ in range(30_000)]
    add(" ".join(long))
    add(" ".join(long[:-5]))
    for text in (None, "", " \n\t ", "one", "one", "one two three", "One  Two three", "a\n\na\na b"):
        add(text)
    add("only a null key here, and nothing else in this text.", None)
    rows.append(rows[0])
    return rows


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    rows = documents()
    table = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    wanted = collections.Counter(
        (k, len(sets[i]), least.get(root(i)), k is not None and k == least.get(root(i))) for i, (k, _, _) in enumerate(rows)
    )
    got = collections.Counter(tuple(r) for r in near_duplicates(table, percent=percent).collect())
    assert got == wanted
    assert len({c for (_, _, c, _) in got}) < len(rows) - 20


def test_no_rows_give_no_rows(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(table).count() == 0
    assert judged(table).count() == 0
    assert pii.found_spans(table).count() == 0
    assert token_counts(table, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_signature_distance_loses_few_pairs():
    assert chunks_for(0.85) == 9
    assert chunks_for(0.8) > 9


def plain_quality(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [t for _, t, _ in documents()]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (2, 3, 4, 5, 60, 5000)]
    texts += ["x y z\n" * 40, "é|ß* a\x0bb\x0c\r\nc" * 20]
    table = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, quality int")
    rows = judged(table).collect()
    for r in rows:
        q = r["_quality"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == plain_quality(r["text"])
    assert not any(r["_quality"].kept and r["_quality"].base_failed for r in rows)


def test_lines_go_before_documents(spark):
    prose = "\n".join(" ".join(VOCABULARY[k : k + 20]).capitalize() + "." for k in range(0, 200, 20))
    junk = " ".join(f"{w}$$$" for w in VOCABULARY[:150])
    menu = "Home\nAll rights reserved."
    table = spark.createDataFrame([(1, prose), (2, junk), (3, prose + "\n" + menu), (4, None)], "doc_id long, text string")
    kept = {r.doc_id: r.quality.cleaned for r in kept_rows(table).collect()}
    assert kept == {1: prose, 3: prose}


BASE = [
    re.compile(p)
    for p in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = (
                True,
                kind != 1 or max(map(int, m[0].split("."))) <= 255,
                16 <= len(digits) <= 19 and pii.luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    parts = [*"a1@.- +()9x", "1.2.3.4", "a@b.c", "4929348385146306", "+1 (171) 555-2028", "\n", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_field_finds_what_patterns_drop_and_leaves_clean_lines(spark):
    hidden = [
        ("in the town +1 (555) 555-0199 10.20.30.40 was on", "phone", "+1 (555) 555-0199"),
        ("la que 5425233430109903 4263982640269299 de la", "card", "4263982640269299"),
        ("please call 312-555-0123 for more", "phone", "312-555-0123"),
    ]
    clean = ["the year 1998 and 2,000 more in 3.5 days", "GNU Library General Public License, version 2.1.", None, "", "no numbers at all"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([h[0] for h in hidden] + clean)], "base long, text string")
    rows = {r["base"]: r for r in pii.found_spans(table).collect()}
    for i, (text, kind, value) in enumerate(hidden):
        assert (kind, value) in {(s.kind, text[s.start : s.end]) for s in rows[i]["added"]}
    for i in range(len(hidden), len(rows)):
        assert not rows[i]["_base"] and not rows[i]["added"]


def test_masking_keeps_other_columns(spark):
    table = spark.createDataFrame(
        [(2**60 + 1, "mail a.b@c.example.org or +1 (171) 555-2028.", None), (None, None, 1.5)], "doc_id long, text string, score double"
    )
    rows = pii.masked(table).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(None, None, 1.5), (2**60 + 1, "mail [EMAIL] or [PHONE].", None)]


def held_out():
    """240 lines with one value each, in four languages and many formats that the base patterns partly miss, and 60 without."""
    rng = random.Random(77)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while True:
            value = rng.choice("45") + digits(15)
            if pii.luhn(value):
                break
        parts = [value[k : k + 4] for k in range(0, 16, 4)]
        return rng.choice([value, " ".join(parts), "-".join(parts)])

    word = lambda: "".join(rng.choice("abcdefgilmnoprstu") for _ in range(rng.randint(3, 8)))
    made = {
        "email": lambda: rng.choice(["{0}@{1}.com", "{0}.{2}@{1}.example.org", "{0} at {1} dot com", "{0} (at) {1}.net", "{0}(at){1}.co.uk", "{0}[at]{1}[dot]org"]).format(word(), word(), word()),
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice(["+1 ({a}) {b}-{c}", "+44 20 {c} {d}", "({a}) {b}-{c}", "{a}-{b}-{c}", "+49 30 {e}", "0171 {e}", "91 {a} {f} {g}", "06 {f} {g} {f} {g}", "030 {h}"]).format(
            a="2" + digits(2), b=digits(3), c=digits(4), d=digits(4), e=digits(7), f=digits(2), g=digits(2), h=digits(6)),
    }
    frames = {
        "email": ["please write to {} soon", "schreiben Sie an {} bitte", "escriba a {} por favor", "contactez {} demain", "contact {}, thanks"],
        "ip": ["the host {} was down", "vom Rechner {} kam nichts", "desde {} no hay nada", "le serveur {} est lent", "ip {} again"],
        "card": ["she paid with card {} today", "Karte {} wurde belastet", "tarjeta {} vencida", "carte {} refus\u00e9e", "pay {} now"],
        "phone": ["call {} after nine", "tel {} abends", "llame al {} hoy", "appelez le {} demain", "my phone is {} at home"],
    }
    lines = [(frames[kind][n % 5], kind, made[kind]()) for kind in pii.KINDS for n in range(60)]
    clean = [
        "in {} there were {} of them", "am {}. Mai kamen {} G\u00e4ste", "el {} de enero costaba {} euros", "page {} sur {}", "version {}.4.1 of part {}",
        "room {} on floor {}",
    ]
    return lines, [rng.choice(clean).format(rng.randint(1, 99), rng.randint(100, 2020)) for _ in range(60)]


def test_held_out_lines():
    finder = pii.Finder(pii.trained())
    lines, clean = held_out()
    found = finder.batch([frame.format(value) for frame, _, value in lines] + clean)
    right, extra, by_kind = 0, 0, collections.Counter()
    for (frame, kind, value), (base, added) in zip(lines, found):
        start = frame.index("{}")
        spans = {(pii.KINDS[k], a, b) for k, a, b in [*base, *added]}
        hit = (kind, start, start + len(value)) in spans
        by_kind[kind] += hit
        right += hit
        extra += len(spans) - hit
    extra += sum(len(base) + len(added) for base, added in found[len(lines) :])
    assert right / len(lines) >= 0.9, by_kind
    assert right / (right + extra) >= 0.9, extra


def test_a_value_is_found_wherever_it_stands_in_a_line():
    finder = pii.Finder(pii.trained())
    for value in ("(212) 555-0147", "bob at example dot com"):
        for n in range(118, 137):
            text = " ".join(["the"] * n + ["reach", value, "for"] + ["the"] * 150)
            (_, added), = finder.batch([text])
            assert [text[a:b] for _, a, b in added] == [value]


def plain_labels(tagger, words):
    """Viterbi word by word over a whole line."""
    scores = [tagger._sum(found) for found in pii.all_features(words)]
    best, back = scores[0] + tagger.starts, []
    for score in scores[1:]:
        routes = best[:, None] + tagger.steps
        back.append(routes.argmax(0))
        best = routes.max(0) + score
    tags = [int(best.argmax())]
    for came in reversed(back):
        tags.append(int(came[tags[-1]]))
    return tags[::-1]


@pytest.mark.parametrize("group", [1, 500, pii.GROUP_WORDS])
def test_lines_are_decoded_whole(monkeypatch, group):
    monkeypatch.setattr(pii, "GROUP_WORDS", group)
    rng = random.Random(4)
    tagger = pii.Tagger(pii.trained())
    labelled = [w for words, _ in pii.labelled_lines() for w in words]
    parts = ["(212)", "555-0147", "+1", "12", "(at)", "bob", "at", "dot", "com", "1.2.3.4", "4929348385146306", "the"]
    lines = [[]] + [[rng.choice(pool) for _ in range(rng.choice((1, 2, 5, 40, 300)))] for pool in (labelled, parts) for _ in range(60)]
    for words, tags in zip(lines, tagger.labels(lines), strict=True):
        assert (tags is None) if not words else tags.tolist() == plain_labels(tagger, words)


TEXTS = ["", "a", " a  b\n\nc \n", "it's we'LL", "don't <|endoftext|> stop<|startoftext|>", "Σας ΣΣ İ ẞ", "x" * 3000, "1234 ½ é́ \U0001f600\x1c\x85a", "\ttab nbsp"]


def test_ids_and_counts_are_the_library_s():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(" \n\tab1'.,é!sΣ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, library = Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):  # the second time from what was kept
        for text, ids in zip(texts, mine.batch(texts), strict=True):
            assert ids == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = Counter(path), Tokenizer.from_file(path)
    for text in texts:
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_counts_of_odd_rows(spark):
    table = spark.createDataFrame([(2**60 + 1, "äb", 1), (None, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, n_tokens int")
    rows = sorted(map(tuple, token_counts(table, public_tokenizers.path("word_bpe_49k.json")).collect()), key=str)
    assert rows[:2] == [(2**60 + 1, 3, 2, False), (3, 0, 0, False)] or len(rows) == 4
    assert (None, 0, 0, False) in rows and any(r[0] == 2**60 + 1 for r in rows)


def test_queries_of_whole_tables(spark, tmp_path):
    from terralume.llm.queries import QUERIES

    rows = [(1, "a@b.example.com 10.0.0.1 4111111111111111 +1 (171) 555-2028"), (2, None), (3, "x +1 (826) 555-4081 190.137.223.204")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_pii_spans"](spark, str(tmp_path)).collect()}
    assert [tuple(got[k])[1:5] for k in (1, 2, 3)] == [(1, 1, 0, 1), (0, 0, 0, 0), (0, 1, 0, 0)]
    assert got[1].spans == "email:0:15,ip:16:24,card:25:41,phone:42:59" and got[2].spans == ""
    assert got[3].spans == "ip:20:35,phone:2:19"
