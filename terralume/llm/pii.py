"""Personal data: base patterns over whole texts, and spans that a linear-chain CRF adds.

The conditional random field reads word shapes: a word's own shape, its digits and marks, and the
coarse class of its neighbours. It is trained from a small labelled table when a job is planned and
decoded by Viterbi over whole lines, in batches in numpy. Base spans always stay; a span of the field is
added where it touches none of them and is plausible for its kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, worker_state
from .tokens import batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
GROUP_WORDS = 1 << 20  # runs of like length are decoded together up to this many words

# Labelled lines for training: {kind:value}. Values are invented: names at example domains, numbers kept for fiction
# or without a subscriber, addresses out of use, and the test numbers that card networks publish.
EXAMPLES = (
    "write to {email:ann.lee@mail.example.org} before monday.",
    "contact {email:sales_07@shop.example.com}, or call {phone:+1 (555) 010-2244}.",
    "und.{email:kurt@post.example.de} ist neu.",
    "send it to {email:bob at example dot com} please",
    "mail {email:j.doe (at) example.net} now",
    "reach {email:maria[at]example[dot]org} for help",
    "escriba a {email:paco (arroba) example.es} hoy",
    "ask {email:ina(at)firm.example.co} about it",
    "call {phone:+44 20 0000 0018} or {phone:+49 30 0000567}.",
    "phone {phone:(212) 555-0100} after nine",
    "tel: {phone:555-555-0109}",
    "the number is {phone:+1 (200) 555-0101} {ip:241.111.222.201} in the log",
    "un. {phone:+1 (201) 555-0102} {ip:242.106.40.202} et la",
    "{phone:+1 (202) 555-0103} {phone:+1 (203) 555-0104}",
    "{phone:+1 (204) 555-0105} {card:4111111111111111} de la",
    "ring {phone:+33 1 00 45 00 89} today",
    "numbers {phone:+1 (205) 555-0106} {card:5555555555554444} {ip:24.21.101.203}",
    "mobile {phone:+1-202-555-0107}, home {phone:202.555.0108}.",
    "{ip:10.0.0.1} {ip:192.168.1.254} {phone:+1 (206) 555-0110}",
    "from {ip:243.38.82.204} to {ip:25.103.101.60}",
    "host {ip:244.17.80.205} | {ip:245.250.100.206} | down",
    "ruf {phone:0170 0000111} an, heute",
    "tel {phone:0151 0002220} abends",
    "Telefon {phone:030 000456} im Haus",
    "llame al {phone:91 000 45 60} mañana",
    "teléfono {phone:93 000 11 20} hoy",
    "appelez le {phone:01 00 20 30 40} demain",
    "tél {phone:06 10 00 30 50} le soir",
    "paid with {card:4242424242424242} yesterday.",
    "card {card:4000 0566 5566 5556} expires soon",
    "card {card:5105-1051-0510-5100}, thanks",
    "tarjeta {card:4012 8888 8888 1881} válida",
    "carte {card:5200-8282-8282-8210} ou rien",
    "que {card:6011111111111117} {card:6011000990139424} aique",
    "the {card:3566002020360505} {card:5200828282828210} {card:4012888888881881} of",
    "pay {card:3530111333300000}. then {email:x99@a.example.io}",
    "{card:4000056655665556} {phone:+1 (207) 555-0111} be",
    "{email:oi.10@mail3.example.net} {email:la.20@mail2.example.net} and",
    "{email:of.30@mail9.example.net} {phone:+1 (208) 555-0112} {ip:26.51.10.207}",
    "{ip:27.51.10.208} {card:5105105105105100} raie,",
)
# Labelled lines without personal data.
CLEAN = (
    "the rain in the north was and of the hill.",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0.",
    "GNU General Public License, version 3.",
    "in 2019 there were 4,512 cases and 12.5 percent more in 2020.",
    "on 12/03/2021 at 10:45 the train left platform 9.",
    "chapter 3.2.1 and section 4.4 of part 12",
    "version 1.2.3.4567 was built from 20230117120000 by hand",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in the file',
    'key "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" was old',
    "see (1) and (2) or (3) in the list.",
    "a 100-200 page book, isbn 978-3-16-148410-0.",
    "the price fell by 1 000 000 to 250 000 euros",
    "room 101, floor 7, 1990-1995.",
    "+ 5 and + 6 are 11",
    "Und die erge, der @ war da.",
    "meet at ten and dot the i",
    "la de que, el y los. una más",
    "THE END!! OF!! IT!!",
    "the&&& of,&&& ing### as%%% a$$$",
    "id 8841293 row 77120934 sum 99",
    "scores 21-14, 7-6 and 30-28",
    "is at the house of",
    "Thtion | edeaing | ntblein | erhaanti.",
    "ssn 000-12-3456 was on file",
    "el 12 de mayo de 2019 y el 3 de junio",
    "am 12. Mai um 10 Uhr 30 waren 45 von 60 da",
    "le 14 juillet 1789, page 12 sur 300",
    "order 0012 4567 of 12 03 2020",
)


class Model(NamedTuple):
    """Weights: features (row 0 for unknown ones) by label, and label by next label."""

    index: dict[str, int]
    weights: object
    steps: object


def labelled_lines(examples: tuple[str, ...] = EXAMPLES, clean: tuple[str, ...] = CLEAN) -> list[tuple[list[str], list[int]]]:
    """Words and labels of the labelled table."""
    lines = []
    for text in (*examples, *clean):
        words, labels = [], []
        for kind, value, plain in re.findall(r"\{(\w+):([^}]*)\}|((?:[^{]|\{(?!\w+:))+)", text):
            inside = f"-{kind}" if kind else ""
            for n, word in enumerate((value or plain).split()):
                if not kind and n == 0 and words and not plain.startswith(" "):
                    words[-1] += word  # a mark that hangs on the value
                    continue
                words.append(word)
                labels.append(LABELS.index(("B" if n == 0 else "I") + inside) if kind else 0)
        lines.append((words, labels))
    return lines


def shape(word: str) -> str:
    """A word's shape: runs of letters as x, digits as their number, other characters as they are."""
    made = re.sub(r"[^\W\d_]+", "x", word)
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", made)


def coarse(word: str) -> str:
    digits = sum("0" <= c <= "9" for c in word)
    if "@" in word:
        return "at" if word == "@" else "mail"
    if not digits:
        low = word.lower().strip("()[].,:;")
        if low in ("at", "dot"):
            return low
        return "word" if low.isalpha() else "marks" if not any(c.isalpha() for c in low) else "mixed"
    if any(c.isalpha() for c in word):
        return "mixed digits"
    if word[0] == "+":
        return "plus"
    if word[0] == "(":
        return "bracket"
    if word.count(".") == 3 and digits >= 4:
        return "dotted"
    if digits >= 13:
        return "long"
    if "-" in word.strip("-"):
        return "dashed"
    return f"number{min(digits, 5)}"


def features(word: str) -> list[str]:
    """Features of a word by itself; all but the cue are about its shape."""
    digits = sum("0" <= c <= "9" for c in word)
    bare = word.strip(".,;:!?\"'")
    low = bare.lower()
    out = ["bias", "s " + shape(bare), "c " + coarse(word), f"n {min(digits, 20)}", f"d {word.count('.')}", f"h {min(word.count('-'), 5)}"]
    if low in ("phone", "tel", "call", "mobile", "ring", "number", "card", "pay", "host", "ip", "mail", "email", "contact"):
        out.append("cue " + low)
    return out


def all_features(words: list[str]) -> list[list[str]]:
    around = ["edge", "edge", *map(coarse, words), "edge", "edge"]
    return [
        [*features(w), "p " + around[i + 1], "q " + around[i], "f " + around[i + 3], "g " + around[i + 4]]
        for i, w in enumerate(words)
    ]


def train(lines: list[tuple[list[str], list[int]]], rounds: int = 120, decay: float = 0.02) -> Model:
    """Maximise the conditional likelihood by adaptive gradient steps; forward and backward sums in numpy."""
    import numpy as np

    index: dict[str, int] = {}
    coded = []
    for words, labels in lines:
        coded.append(([[index.setdefault(f, len(index) + 1) for f in found] for found in all_features(words)], labels))
    size, n = max(len(words) for words, _ in lines), len(LABELS)
    weights, steps = np.zeros((len(index) + 1, n)), np.zeros((n, n))
    seen_w, seen_s = np.full_like(weights, 1e-8), np.full_like(steps, 1e-8)
    width = max(len(f) for found, _ in coded for f in found)
    ids = np.zeros((len(coded), size, width), np.int64)
    gold = np.zeros((len(coded), size), np.int64)
    mask = np.zeros((len(coded), size), bool)
    for r, (found, labels) in enumerate(coded):
        mask[r, : len(labels)] = True
        gold[r, : len(labels)] = labels
        for i, f in enumerate(found):
            ids[r, i, : len(f)] = f
    rows = np.arange(len(coded))
    hot = np.eye(n)[gold] * mask[:, :, None]
    pairs = np.einsum("rti,rtj->ij", hot[:, :-1], hot[:, 1:])

    def total(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for _ in range(rounds):
        score = weights[ids].sum(2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, size):
            moved = total(ahead[:, t - 1, :, None] + steps, 1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
        whole = total(ahead[rows, -1], 1)
        for t in range(size - 2, -1, -1):
            moved = total(steps + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        chance = np.exp(ahead + behind - whole[:, None, None]) * mask[:, :, None]
        both = ahead[:, :-1, :, None] + steps + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        slope = np.zeros_like(weights)
        np.add.at(slope, ids[mask], (hot - chance)[mask][:, None, :])
        slope[0] = 0
        slope -= decay * weights
        slope_s = pairs - expected - decay * steps
        seen_w += slope**2
        seen_s += slope_s**2
        weights += 0.5 * slope / np.sqrt(seen_w)
        steps += 0.5 * slope_s / np.sqrt(seen_s)
    allowed = np.array([[b[0] != "I" or a[2:] == b[2:] for b in LABELS] for a in LABELS])
    return Model(index, weights, np.where(allowed, steps, -1e3))


class Tagger:
    """Scores words through their profiles and decodes lines together."""

    def __init__(self, model: Model):
        import numpy as np

        self.index, self.weights, self.steps = model
        self.steps_t = np.ascontiguousarray(np.asarray(self.steps).T)
        self.known: dict[str, int] = {}
        self.by_features: dict[tuple, int] = {}
        self.own: list = []
        self.kind: list[int] = []
        self.classes: dict[str, int] = {"edge": 0}
        self.starts = np.array([-1e3 if x[0] == "I" else 0.0 for x in LABELS])

    def _sum(self, found: list[str]):
        return sum((self.weights[self.index[f]] for f in found if f in self.index), start=self.weights[0])

    def profile(self, word: str) -> int:
        """Words with the same features share a profile."""
        found = features(word)
        name = tuple(f for f in found if f in self.index)
        kind = coarse(word)
        at = self.by_features.get((name, kind))
        if at is None:
            at = self.by_features[(name, kind)] = len(self.own)
            self.own.append(self._sum(found))
            self.kind.append(self.classes.setdefault(kind, len(self.classes)))
        if len(word) <= 64:
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[word] = at
        return at

    def labels(self, lines: list[list[str]]) -> list:
        """Label numbers of the words of each line, in numpy arrays."""
        import numpy as np

        known, profile = self.known, self.profile
        flat = np.fromiter((known[w] if w in known else profile(w) for line in lines for w in line), np.int64)
        sizes = np.array([len(x) for x in lines])
        ends = np.cumsum(sizes)
        own, kind = np.array(self.own), np.array(self.kind)
        context = {p: np.array([self._sum([f"{p} {c}"]) for c in self.classes]) for p in "pqfg"}
        begins = ends - sizes
        which = kind[flat]
        place = np.arange(len(flat)) - np.repeat(begins, sizes)
        left = np.repeat(sizes, sizes) - place - 1
        score = own[flat]
        for p, step, room in (("p", -1, place), ("q", -2, place), ("f", 1, left), ("g", 2, left)):
            near = np.where(room >= abs(step), np.roll(which, -step), 0)
            score += context[p][near]
        tags = np.zeros(len(flat), np.int8)
        # Words that are surely outside part a line into runs, which don't depend on each other.
        unsure = ~self._outside(score)
        begins_run = np.flatnonzero(unsure & ((place == 0) | ~np.roll(unsure, 1)))
        ends_run = np.flatnonzero(unsure & ((left == 0) | ~np.roll(unsure, -1))) + 1
        order = np.argsort(ends_run - begins_run, kind="stable")
        begins_run, ends_run = begins_run[order], ends_run[order]
        long = ends_run - begins_run
        low = 0
        while low < len(long):
            fits = np.flatnonzero(long[low : low + GROUP_WORDS] * np.arange(1, len(long[low : low + GROUP_WORDS]) + 1) <= GROUP_WORDS)
            high = low + max(1, len(fits))
            part = begins_run[low:high]
            first = np.where((place[part] == 0)[:, None], self.starts, self.steps[0])
            last = np.where((left[ends_run[low:high] - 1] == 0)[:, None], 0.0, self.steps_t[0])
            self._viterbi(score, part, long[low:high], first, last, tags)
            low = high
        return [tags[b:e] if e > b else None for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _outside(self, score):
        """Words that are O on every best path: each span over them scores less than O in its place.

        The bound of a span is its best start up to the word and its best end behind it, both as running
        maxima over sums; it may take the dearest neighbours and cross the ends of lines.
        """
        import numpy as np

        steps, free = self.steps, [i for i, x in enumerate(LABELS) if x[0] != "I"]
        sure = np.ones(len(score), bool)
        for b in range(1, len(LABELS), 2):  # B- of a kind, its I- is the next label
            before = max(0.0, (steps[:, b] - steps[:, 0]).max())
            behind = max(0.0, (steps[b : b + 2, free] - steps[0, free]).max())
            start = score[:, b] - score[:, 0] + before
            total = np.cumsum(score[:, b + 1] - score[:, 0] + (steps[b : b + 2, b + 1].max() - steps[0, 0]))
            left = total + np.maximum.accumulate(start - total)
            right = np.maximum.accumulate(total[::-1])[::-1] - total
            sure &= left + right + behind < -1e-4
        return sure

    def _viterbi(self, score, begins, sizes, first, last, tags) -> None:
        """Write the labels of runs, shortest first, into ``tags``; ``first`` and ``last`` score their ends."""
        import numpy as np

        n, longest = len(LABELS), int(sizes[-1])
        best = score[begins] + first
        back = np.empty((longest, len(begins), n), np.int8)
        live = np.searchsorted(sizes, np.arange(longest), side="right")
        for t in range(1, longest):
            k = live[t]
            routes = best[k:, None, :] + self.steps_t[None]
            came = routes.argmax(2)
            back[t, k:] = came
            best[k:] = np.take_along_axis(routes, came[:, :, None], 2)[:, :, 0] + score[begins[k:] + t]
        now = (best + last).argmax(1)
        rows = np.arange(len(begins))
        for t in range(longest - 1, -1, -1):
            k = live[t]
            tags[begins[k:] + t] = now[k:]
            if t:
                now[k:] = back[t, rows[k:], now[k:]]


_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(WORD)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind, in linear time."""
    out = []
    # An address is found from its @; the local part is the run of characters before it.
    end = 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append((0, start, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def plausible(kind: int, value: str) -> bool:
    digits = len(_digits(value))
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s*(?:@|[\[(]at[\])]|\bat\b)\s*[\w-]+(?:\s*(?:\.|[\[(]dot[\])]|\bdot\b)\s*[\w-]+)+", value, re.I))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value)) and all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 13 <= digits <= 19 and luhn(_digits(value))
    return 7 <= digits <= 15 and not re.search(r"[^\x20+().0-9-]", value)


def overlaps(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


class Finder:
    def __init__(self, model: Model):
        self.tagger = Tagger(model)

    def batch(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Base spans and added spans of whole texts; a null text has none."""
        lines, at = [], []
        for k, text in enumerate(texts):
            for line in (text or "").split("\n"):
                lines.append(_WORD.findall(line))
                at.append(k)
        labels = self.tagger.labels(lines) if any(lines) else [None] * len(lines)
        marked: dict[int, list[int]] = {}
        for k, words, tags in zip(at, lines, labels, strict=True):
            found = marked.setdefault(k, [])
            if tags is not None and tags.any():
                # Words are counted over the text; only marked ones are kept.
                found.append((tags, len(words)))
            else:
                found.append((None, len(words)))
        out = []
        for k, text in enumerate(texts):
            base = base_spans(text) if text else []
            added = self._added(text, marked[k], base) if any(t is not None for t, _ in marked.get(k, ())) else []
            out.append((base, added))
        return out

    def _added(self, text: str, parts: list, base: list) -> list[tuple[int, int, int]]:
        import numpy as np

        tags = np.concatenate([np.zeros(n, np.int8) if t is None else t for t, n in parts])
        places = [m.span() for m in _WORD.finditer(text)]
        out, i = [], 0
        for i in np.flatnonzero(tags).tolist():
            if LABELS[tags[i]][0] != "B":
                continue
            kind, j = (int(tags[i]) - 1) // 2, i + 1
            while j < len(tags) and tags[j] == tags[i] + 1 and "\n" not in text[places[j - 1][1] : places[j][0]]:
                j += 1
            start, end = places[i][0], places[j - 1][1]
            # Marks around a value aren't part of it.
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not (text[end - 1].isalnum() or text[end - 1] in ")]"):
                end -= 1
            if end > start and not overlaps(base, start, end) and not overlaps(out, start, end) and plausible(kind, text[start:end]):
                out.append((kind, start, end))
        return out


def trained() -> Model:
    return train(labelled_lines())


SPAN = "array<struct<kind:string,start:int,end:int>>"


def found_spans(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of ``kind``, ``start``, ``end`` (code points, end exclusive).

    Both are in order of kind as listed, then start. A null or empty text has none. Every row is
    read by itself, whatever its key; new names get underscores in front where they clash.
    """
    model = model or trained()
    base, added = free_name(docs.columns, "base"), free_name(docs.columns, "added")

    place = docs.columns.index(text)

    def work(frames: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        # A worker keeps the finder of a model; the store is keyed by its weights.
        finder = worker_state(f"finder {hash(model.weights.tobytes())}", lambda: Finder(model))

        def shown(spans: list) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

        for frame in frames:
            texts, found = frame.column(place).to_pylist(), []
            for low, high in batches(texts):
                found += finder.batch(texts[low:high])
            columns = [*frame.columns, pa.array([shown(b) for b, _ in found], kind), pa.array([shown(a) for _, a in found], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*frame.schema.names, base, added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(work, f"{fields}, `{base}` {SPAN}, `{added}` {SPAN}")


def masked(docs: DataFrame, text: str = "text", model: Model | None = None, mask: Callable[[str], str] = lambda kind: f"[{kind.upper()}]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind's mask; nulls stay null."""
    rows = found_spans(docs, text, model)
    base, added = rows.columns[-2:]
    marks = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(mask(k)))])
    by_place = F.array_sort(
        F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    p = free_name([c[:4] for c in docs.columns], "pii_")
    rows = rows.withColumn(f"{p}spans", by_place)
    # Spans of different kinds can overlap: what was covered stays covered, one mask for the run.
    cut = F.aggregate(
        f"{p}spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(s["out"].alias("out"), F.greatest(s["at"], x["end"]).alias("at"))).otherwise(
            F.struct(
                F.concat(s["out"], F.substring(F.col(f"`{text}`"), s["at"] + 1, x["start"] - s["at"]), marks[x["kind"]]).alias("out"),
                x["end"].alias("at"),
            )
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(f"`{text}`"), s["at"] + 1, F.length(F.col(f"`{text}`")))),
    )
    made = F.when(F.size(f"{p}spans") > 0, cut).otherwise(F.col(f"`{text}`"))
    return rows.select(*[(made if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
