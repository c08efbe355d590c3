"""Token ids of whole texts by the tokenizers library, with a bounded memo of the
parts of words. Exact for tokenizers whose pre-tokenizer drops white space and ends a
word between a letter and punctuation (as word_bpe_49k.json does): no token crosses
such a border, so the ids of a text are the joined ids of its parts."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from .text_arrays import code_points, letters, run_hashes

#: Parts kept at once; beyond that the memo starts anew (bounded memory).
MEMO_PARTS = 1_000_000
#: Letters below this code point may be lower-cased sign by sign.
PLAIN = 0x250
#: Punctuation that never opens a contraction.
PUNCT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Told into the hash of parts that are kept as they are.
SALT = np.uint64(0xA5A5A5A5DEADBEEF)


@lru_cache(maxsize=1)
def plain_signs() -> tuple[np.ndarray, np.ndarray]:
    """Of code points below PLAIN, and PLAIN for all others: the lower case, and the kind
    (1: letter whose lower case is one such letter, 2: PUNCT, 0: other)."""
    low, kind = np.arange(PLAIN + 1, dtype=np.uint32), np.zeros(PLAIN + 1, dtype=np.int8)
    for c in range(PLAIN):
        k = chr(c).lower()
        if letters()[c] and len(k) == 1 and ord(k) < PLAIN and letters()[ord(k)]:
            low[c], kind[c] = ord(k), 1
    kind[[ord(c) for c in PUNCT]] = 2
    return low, kind


class WordIds:
    """``encode(texts)`` -> (ids of all texts, number of ids of each), equal to
    ``encode(text, add_special_tokens=False).ids``.

    Texts are cut at spaces and line feeds, and a word of plain letters with a run of
    punctuation behind it into both. Parts are told apart by a 64-bit hash, looked up
    all together (one sort for a batch), and only parts not met before become strings:
    lower-case letters go to the library's model directly, in the byte-level alphabet;
    all else (punctuation, digits, apostrophes, special strings, other scripts) is
    encoded as it is.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from .transducer import byte_signs

        self.tok = Tokenizer.from_file(path)
        self.signs = str.maketrans({chr(b): s for b, s in enumerate(byte_signs())})
        self._reset()

    def _reset(self) -> None:
        self.hash = np.empty(0, dtype=np.uint64)  # sorted
        self.at, self.n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)  # where in ids, how many
        self.ids = np.empty(0, dtype=np.uint32)

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(hashes), dtype=bool)
        return self.hash[np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)] != hashes

    def _learn(self, hashes: np.ndarray, parts: list[str], lowered: np.ndarray) -> None:
        """Add parts (none is known yet)."""
        rows: list = [None] * len(parts)
        tokenize, alone = self.tok.model.tokenize, []
        for k, (part, low) in enumerate(zip(parts, lowered.tolist())):
            if low:
                part = part.lower()
                sign = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
                rows[k] = [t.id for t in tokenize(sign)]
            else:
                alone.append(k)
        for k, e in zip(alone, self.tok.encode_batch_fast([parts[k] for k in alone], add_special_tokens=False)):
            rows[k] = e.ids
        n = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = array("I")
        for r in rows:
            flat.extend(r)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.frombuffer(flat, dtype=np.uint32)])
        place = np.searchsorted(self.hash, hashes)  # hashes come sorted
        self.hash, self.at, self.n = (np.insert(a, place, b) for a, b in ((self.hash, hashes), (self.at, at), (self.n, n)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = "\n".join(texts) + "\n"
        cp = code_points(whole)
        low_of, kind_of = plain_signs()
        small = np.minimum(cp, PLAIN)
        kind = kind_of[small]
        low = np.where(kind == 1, low_of[small], cp)
        gap = (cp == 32) | (cp == 10)
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        start, end = edge[::2], edge[1::2]
        # plain words: letters, then perhaps punctuation
        letter = np.concatenate(([0], np.cumsum(kind == 1, dtype=np.int32)))
        signs = np.concatenate(([0], np.cumsum(kind != 0, dtype=np.int32)))
        middle = start + (letter[end] - letter[start])
        plain = (middle > start) & (signs[end] - signs[start] == end - start) & (letter[middle] - letter[start] == middle - start)
        two = plain & (middle < end)
        count = 1 + two
        last = np.cumsum(count) - 1  # of each word's parts
        a, b = np.repeat(start, count), np.repeat(end, count)
        a[last[two]] = middle[two]
        b[last[two] - 1] = middle[two]
        lowered = np.repeat(plain, count)
        lowered[last[two]] = False
        h = np.where(lowered, run_hashes(low, a, b), run_hashes(cp, a, b) ^ SALT)

        known, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = self._unknown(known)
        if len(self.hash) + new.sum() > MEMO_PARTS:
            self._reset()
            new = self._unknown(known)
        if new.any():
            where = first[new]
            self._learn(known[new], [whole[x:y] for x, y in zip(a[where].tolist(), b[where].tolist())], lowered[where])
        slot = np.searchsorted(self.hash, known)
        n = self.n[slot][inverse]
        done = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[slot][inverse] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        # ids of each text: parts before its end
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        total = np.concatenate(([0], done))[np.searchsorted(a, ends)]
        return ids, np.diff(total, prepend=0)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One per Python worker: its memo lives on from task to task."""
    return WordIds(path)
