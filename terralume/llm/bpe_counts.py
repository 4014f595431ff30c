"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

For each chunk the symbols form a linked list and every adjacent pair that can merge waits in a
heap under its rank. The lowest pair is merged until none is left; the count is the number of
symbols at the start less the merges. Counts of pieces met before are kept by the worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

KEPT_PIECES = 400_000  # pieces of each of two generations that a worker keeps
KEPT_LENGTH = 64
# Letters that Unicode added lately, on which libraries differ; the tokenizer's own steps cut such texts.
RECENT = re.compile("[\ua7c0-\ua7df\U0002fa20-\U000dffff]")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Counter:
    """Counts tokens as a lower-casing word-end BPE tokenizer file gives them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            settings = json.load(source)
        model, cut = settings["model"], settings["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in settings["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"] or not cut[0]["invert"]:
            raise ValueError("this counter reads tokenizers that drop blanks, lower-case and mark word ends")
        pattern = cut[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.chunks = regex.compile(pattern).findall
        self.blanks = regex.compile(r"\p{White_Space}+").split
        self.added = re.compile("|".join(re.escape(t["content"]) for t in settings["added_tokens"]) or r"(?!)")
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        number: dict[str, int] = {}

        def of(symbol: str) -> int:
            return number.setdefault(symbol, len(number))

        self.number = of
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.merges = {(of(a), of(b)): (rank, of(a + b)) for rank, (a, b) in enumerate(pairs)}
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        """Tokens of one chunk."""
        return self.merged_letters([self.letters[b] for b in chunk.encode("utf-8", "surrogatepass")])

    def merged_letters(self, letters: list[str]) -> int:
        """Symbols at the start less the merges."""
        letters[-1] += self.suffix
        symbol = [self.number(x) for x in letters]
        n, merges = len(symbol), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(symbol, symbol[1:], strict=False)) if p in merges]
        # Entries: rank, made symbol, place, pair; equal ranks are the same pair, so the place decides.
        heapq.heapify(heap)
        count = n
        while heap:
            _, made, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (symbol[i], symbol[j]) != pair:
                continue
            count -= 1
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (made, symbol[k])) in merges:
                    heapq.heappush(heap, (*merges[p], i, p))
            if (h := before[i]) >= 0 and (p := (symbol[h], made)) in merges:
                heapq.heappush(heap, (*merges[p], h, p))
        return count

    def piece(self, piece: str) -> int:
        """Tokens of a normalised piece without blanks."""
        found = self.known.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                chunks = self.chunks(piece)
                found = sum(map(self.merged if len(chunks) == 1 else self.piece, chunks))
            if len(piece) <= KEPT_LENGTH:
                if len(self.known) >= KEPT_PIECES:
                    self.known, self.older = {}, self.known
                self.known[piece] = found
        return found

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; strings of added tokens are one each, a null text has none."""
        if not text:
            return 0
        parts = self.added.split(text) if "<" in text else [text]
        total = len(parts) - 1
        for part in parts:
            if not part.isascii() and RECENT.search(part):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                total += sum(self.merged_letters(list(letters)) for letters, _ in cut)
                continue
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            pieces = self.blanks(plain) if re.search("[\x1c-\x1f]", plain) else plain.split()
            known, piece = self.known, self.piece
            total += sum([known[p] if p in known else piece(p) for p in pieces])
        return total


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` for each row; no shuffle.

    A null or empty text has no bytes and no tokens. Repeated rows and null keys give a row each;
    other columns are ignored, an empty table gives none.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = worker_state(f"counter {path}", lambda: Counter(path))
        for batch in batches:
            counts = [counter.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    made = rows.mapInArrow(work, f"key {kind}, n_bytes long, n_tokens long")
    return made.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
