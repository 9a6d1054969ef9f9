"""Encoding texts piece by piece with a cache of pieces, for tokenizers that split before they merge.

The splitting pattern of byte-level BPE always starts a token at a single space between two characters that are
not white space, whatever stands around, and at such a line break too. Where all white space of a text is of this
kind, the text is cut there and each distinct piece is encoded once. Letters and a mark that ends a piece are apart as well,
so a word is encoded once for all the marks that follow it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Marks that may end a piece after a letter.
MARKS = ".,;:!?"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
# Stands before the first piece of a text, which has no space before it; no text that is cut holds this character.
HEAD = "\t"
# Characters of text taken together, and pieces in each of two generations of the cache: both bound a worker's
# memory, not what is encoded.
TOGETHER, REMEMBERED = 1_000_000, 220_000


def separable(text: str) -> bool:
    """Whether each white space is one space or line break between two other characters."""
    return bool(text) and not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or any(c in text for c in WHITE))


class PieceEncoder:
    """Packed ids of texts. ``encode_many`` gives the packed ids of each of a list of strings."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], whole: Iterable[str] = (),
                 remembered: int = REMEMBERED):
        self.encode_many, self.whole, self.remembered = encode_many, tuple(whole), remembered
        self.known, self.aged = {}, {}
        self.marks = dict(zip(MARKS, encode_many(list(MARKS))))

    def encode(self, texts: Iterable[str]) -> Iterable[bytes]:
        """Ids of each text in turn, as packed little-endian unsigned 32-bit integers."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= TOGETHER:
                yield from self._encode(held)
                held, chars = [], 0
        yield from self._encode(held)

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct pieces, in their order; those not met before are encoded in one go."""
        ids = list(map(self.known.get, pieces))
        if None not in ids:
            return ids
        missing = [p for p, v in zip(pieces, ids) if v is None]
        # Pieces that are met again come back from the older generation, so frequent ones stay.
        self.known.update((p, v) for p in missing if (v := self.aged.get(p)) is not None)
        new = [p for p in missing if p not in self.known]
        ending = [p for p in new if p[-1] in self.marks and p[-2:-1].isalpha()]
        apart = dict.fromkeys(p for p in new if not (p[-1] in self.marks and p[-2:-1].isalpha()))
        apart.update(dict.fromkeys(s for p in ending if (s := p[:-1]) not in self.known))
        led = [p if p[0] == "\n" else p[1:] if p[0] == HEAD else " " + p for p in apart]
        self.known.update(zip(apart, self.encode_many(led)))
        self.known.update((p, self.known[p[:-1]] + self.marks[p[-1]]) for p in ending)
        return [self.known[p] if v is None else v for p, v in zip(pieces, ids)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """All pieces of the texts are told apart in one column, so only distinct ones are looked up."""
        if len(self.known) > self.remembered:
            self.known, self.aged = {}, self.known
        cut = [separable(t) and not any(w in t for w in self.whole) for t in texts]
        others = iter(self.encode_many([t for t, c in zip(texts, cut) if not c]))
        if not any(cut):
            return list(others)
        led = pa.array([HEAD + t.replace("\n", " \n") for t, c in zip(texts, cut) if c], pa.large_string())
        pieces = pc.split_pattern(led, " ")
        found = pieces.values.dictionary_encode()
        ids = pa.array(self._look_up(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[pieces.offsets.to_numpy()].tolist()
        packed = memoryview(ids.buffers()[2])
        parts = (bytes(packed[a:b]) for a, b in zip(ends, ends[1:]))
        return [next(parts) if c else next(others) for c in cut]
