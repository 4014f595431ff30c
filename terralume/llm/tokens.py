"""Whole texts to token ids with the tokenizers library, one call for many new pieces.

A byte-level tokenizer cuts a text before it merges, and a single blank or line feed behind other
characters always opens a new chunk, as does a mark behind a letter. Prose repeats such pieces: the
pieces of many texts are numbered by Arrow, ids are looked up once for each distinct piece, and
numpy puts them together. Each worker keeps the ids of the pieces it has met and asks the library only
for new ones, many in one call. The ids are those of a call on the whole text; texts with other
white space than single blanks and line feeds, or with strings of added tokens, go to the library as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from .common import worker_state

KEPT_PIECES = 600_000  # pieces of each of two generations that a worker keeps
KEPT_LENGTH = 64  # longer pieces are encoded each time
JOINED_PIECES = 4000  # new pieces in one call
BLANK, MARK, LETTER = 1, 2, 3
_KINDS = bytes(BLANK if b in b" \n" else MARK if b in b".,;:!?" else LETTER if bytes([b]).isalpha() else 0 for b in range(256))
# White space but blank and line feed, and the separators that some libraries count as white space.
OTHER_SPACES = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers.

    With ``plain`` the strings of added tokens are ordinary text. ``kept`` bounds the store of pieces.
    """

    def __init__(self, path: str, plain: bool = False, kept: int = KEPT_PIECES):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as source:
            settings = json.load(source)
        cut = settings.get("pre_tokenizer") or {}
        by_pieces = (
            settings.get("normalizer") is None
            and settings.get("post_processor") is None
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space", True)
        )
        self.by_pieces = by_pieces
        self.added = [] if plain else [t["content"] for t in settings.get("added_tokens", [])]
        # Byte-level vocabularies write each byte as one character.
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.id_bytes[number] = len(token)
        self.kept = kept
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learned(self, new: list[bytes]) -> list[bytes]:
        """Ids of many pieces that open with a blank or a line feed, in calls for many of them.

        The bytes that the ids stand for tell where a piece ends.
        """
        import numpy as np

        out: list[bytes] = []
        for k in range(0, len(new), JOINED_PIECES):
            part = new[k : k + JOINED_PIECES]
            found = self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            at = [0, *(np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum([len(p) for p in part])) + 1).tolist()]
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, from those met before and the library."""
        if len(self.known) > self.kept:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [known.get(p) for p in pieces]
        places, opened = [], []
        for k, ids in enumerate(found):
            if ids is not None:
                continue
            piece = pieces[k]
            ids = older.get(piece)
            if ids is None:
                if len(piece) <= KEPT_LENGTH and piece[0] in b" \n":
                    places.append(k)
                    opened.append(piece)
                    continue
                ids = self.whole(piece.decode())
            found[k] = ids
            if len(piece) <= KEPT_LENGTH:
                known[piece] = ids
        new = self._learned(opened)
        known.update(zip(opened, new, strict=True))
        for k, ids in zip(places, new, strict=True):
            found[k] = ids
        return found  # type: ignore[return-value]

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that can be cut; none is empty."""
        import numpy as np
        import pyarrow as pa

        parts = [t.encode() for t in texts]
        data = b"".join(parts)
        starts = np.cumsum([0, *map(len, parts)], dtype=np.int64)
        kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
        opens = kinds == BLANK
        opens[1:] |= (kinds[1:] == MARK) & (kinds[:-1] == LETTER)
        opens[starts[:-1]] = True
        places = np.flatnonzero(opens)
        offsets = np.append(places, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        found = self._ids_of(pieces.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) for x in found], np.int64) // 4
        of = pieces.indices.to_numpy()
        lengths = sizes[of]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()
        bounds = (4 * np.append(0, ends)[np.searchsorted(places, starts)]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _fits(self, text: str) -> bool:
        return (
            self.by_pieces
            and not OTHER_SPACES(text)
            and not any(t in text for t in (*self.added, "  ", " \n", "\n ", "\n\n"))
            and text[-1] not in " \n"
        )

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, 4 bytes each; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[int] = []
        for k, text in enumerate(texts):
            if text and self._fits(text):
                cut.append(k)
            elif text:
                out[k] = self.whole(text)
        if cut:
            for k, ids in zip(cut, self._cut([texts[k] for k in cut]), strict=True):  # type: ignore[misc]
                out[k] = ids
        return out


def encoder(path: str, plain: bool = False, kept: int = KEPT_PIECES) -> Encoder:
    return worker_state(f"encoder {path} {plain} {kept}", lambda: Encoder(path, plain, kept))


def batches(texts: list[str | None], chars: int = 1_000_000) -> Iterable[tuple[int, int]]:
    """Bounds of runs of texts with about ``chars`` characters each."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
