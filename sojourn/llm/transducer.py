"""A BPE tokenizer compiled to a deterministic finite-state transducer whose
transitions are annotated with emitted-token counts.

The input is the normalised text, sign by sign. A state is a scanner mode (which
alternative of the pre-tokenizer's pattern is open) and, inside a word, the
frontier of byte-pair encoding: for every suffix of the word read so far that some
token begins with, the place in the tokens' trie, the last token of the encoding
before that suffix, and the token count there relative to the count now. The
encoding of a string is the only sequence of tokens whose neighbours all
"stand": no merge across their border comes before the merges that made them.
So the last token after one more byte follows from the frontier alone, and the
frontier is finite: suffixes are no longer than the longest token. States are
compiled when first met and kept in a bounded table. Counts on transitions are
differences, so they may be zero or negative while a word is open; the count
after the word's end is the number of its tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

#: Bounds of what a Python worker keeps.
MAX_STATES, MAX_WORDS, MAX_WORD_CHARS = 150_000, 300_000, 48
#: Nodes with at most so many tokens below them tell the tokens before them apart by what may follow.
FEW = 32
INFINITE = float("inf")
START = 0
#: How a chunk forgets the state before it: never, by ending the word after its head, or by the
#: head itself, after which the state is the same whatever came before.
NEVER, ENDS, KNOWN = 0, 1, 2
#: The contractions that the pre-tokenizer's pattern tries first.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Signs that never open a contraction.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space for the pattern, beside what str.split() knows.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte (byte-level alphabet): itself
    where it is printable, else the next free sign from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Transducer:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        end = spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        signs = byte_signs()
        #: Symbols: byte b inside a word is b, as the last of a word 256 + b.
        name = [*signs, *(s + end for s in signs)]
        symbol = {vocab[n]: k for k, n in enumerate(name) if n in vocab}
        n = max(vocab.values()) + 1
        self.made, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.rank: dict[tuple[int, int], int] = {}
        spelled: dict[int, tuple] = {t: (s,) for t, s in symbol.items()}
        stands_alone = dict.fromkeys(spelled, True)
        #: Pairs of symbols that stand side by side in some token: every one of them was merged once.
        self.side_by_side: set[tuple[int, int]] = set()
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            t = vocab[pair[0] + pair[1] if isinstance(pair, list) else pair.replace(" ", "")]
            self.rank[a, b] = rank
            self.side_by_side.add((spelled[a][-1], spelled[b][0]))
            if t not in spelled:
                self.made[t], self.left[t], self.right[t] = rank, a, b
                spelled[t] = spelled[a] + spelled[b]
                stands_alone[t] = stands_alone[a] and stands_alone[b] and self._stands(a, b, rank)
        #: Trie over symbols: node -> {symbol: node}; the token that ends at a node.
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t in sorted(t for t in spelled if stands_alone[t]):
            node = 0
            for s in spelled[t]:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                node = self.trie[node][s]
            self.token[node] = t
        self.longest = max(map(len, spelled.values()))
        from tokenizers import Tokenizer

        self.cutter, self.kinds = Tokenizer.from_file(path).pre_tokenizer, {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.below: dict[int, list[int] | None] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.classes: dict[tuple[int, int], int] = {}
        self.words: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.contraction = {c: self._whole(c) for c in CONTRACTIONS}
        self._clear()

    # -- byte-pair encoding ------------------------------------------------
    def _stands(self, l: int, r: int, bound: float) -> bool:  # noqa: E741
        """No merge across the border of l and r comes before the merges that made
        them (and before ``bound``): undo those merges, last first, and look."""
        rank, made = self.rank, self.made
        while True:
            if rank.get((l, r), bound) < bound:
                return False
            a, b = made[l], made[r]
            if a < 0 and b < 0:
                return True
            if a > b:
                bound, l = a, self.right[l]  # noqa: E741
            else:
                bound, r = b + 1, self.left[r]

    def _follows(self, last: int, token: int) -> bool:
        if last < 0:
            return True
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[last, token] = self._stands(last, token, INFINITE)
        return known

    def _below(self, node: int) -> list[int] | None:
        """Tokens that go on from a node of the trie; None if more than FEW."""
        if node not in self.below:
            out, open_ = [], list(self.trie[node].values())
            while open_ and len(out) <= FEW:
                k = open_.pop()
                if self.token[k] >= 0:
                    out.append(self.token[k])
                open_ += self.trie[k].values()
            self.below[node] = out if len(out) <= FEW else None
        return self.below[node]

    def _alike(self, node: int, before: int) -> int | None:
        """Which token may stand for ``before`` in front of ``node``: one after which the
        same tokens below the node may follow; None if none may. Merges states."""
        below = self._below(node)
        if below is None:
            return before
        known = self.alike.get((node, before), -2)
        if known == -2:
            if len(self.alike) > 500_000:
                self.alike.clear()
            rank, stands = 0, self._stands
            for k, t in enumerate(below):
                if before < 0 or stands(before, t, INFINITE):
                    rank |= 1 << k
            known = self.classes.setdefault((node, rank), before) if rank else None
            self.alike[node, before] = known
        return known

    def _push(self, frontier: tuple, symbol: int, within: bool = False) -> tuple[tuple, int]:
        """Frontier after one more symbol, and the change of the token count. ``within``: the
        frontier lacks what began earlier, so an encoding may have no token that ends here."""
        trie, token, open_, last, count = self.trie, self.token, [], -1, 0
        for node, before, rel in frontier:
            child = trie[node].get(symbol)
            if child is None:
                continue
            if last < 0 and (t := token[child]) >= 0 and self._follows(before, t):
                last, count = t, rel + 1
            if trie[child] and (before := self._alike(child, before)) is not None:
                open_.append((child, before, rel))
        if last < 0:
            assert within, "every byte is a token, so some token always ends here"
            return tuple(open_), 0
        return (*((c, b, rel - count) for c, b, rel in open_), (0, last, 0)), count

    FRESH = ((0, -1, 0),)

    # -- states: (mode, frontier, pending byte) -------------------------------
    def _clear(self) -> None:
        self.keys: list[tuple] = [("", (), -1)]
        self.ids: dict[tuple, int] = {self.keys[0]: START}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[int | None] = [0]

    def state(self, key: tuple) -> int:
        """Number of a state in this worker; ``key`` is the same in every worker."""
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
            self.ends.append(None)
        return self.ids[key]

    def _kind(self, c: str) -> str:
        """L: letter, N: number, O: other, as the library's own tables have it."""
        if c not in self.kinds:
            if len(self.kinds) > 20_000:
                self.kinds.clear()
            cut = self.cutter.pre_tokenize_str
            self.kinds[c] = "L" if len(cut("a" + c)) == 1 else "O" if cut("!" + c)[0][1][1] == 2 else "N"
        return self.kinds[c]

    def _read(self, frontier: tuple, pending: int, c: str) -> tuple[tuple, int, int]:
        count = 0
        for b in c.encode("utf-8", "surrogatepass"):
            if pending >= 0:
                frontier, d = self._push(frontier, pending)
                count += d
            pending = b
        return frontier, pending, count

    def _parts(self, pending: int, c: str) -> bool:
        """No token reaches over the border between byte ``pending`` and the sign c: what
        stands on both sides is encoded by itself."""
        first = c.encode("utf-8", "surrogatepass")[0]
        return (pending, first) not in self.side_by_side and (pending, 256 + first) not in self.side_by_side

    def _whole(self, word: str) -> int:
        frontier, pending, count = self._read(self.FRESH, -1, word)
        return count + self._push(frontier, 256 + pending)[1]

    def _close(self, key: tuple) -> int:
        """Tokens still to come if the open word ends here."""
        mode, frontier, pending = key
        if mode in ("L", "O"):
            return self._push(frontier, 256 + pending)[1]
        if mode:  # an apostrophe, and the first letter of a contraction that did not come
            return self._whole("'") + (self._whole(mode[1]) if len(mode) > 1 else 0)
        return 0

    def _move(self, key: tuple, c: str) -> tuple[tuple, int]:
        mode, frontier, pending = key
        kind = self._kind(c)
        if mode == "":
            if kind == "N":
                return self.keys[START], self._whole(c)
            if c == "'":
                return ("'", (), -1), 0
            frontier, pending, count = self._read(self.FRESH, -1, c)
            return (kind, frontier, pending), count
        if mode in ("L", "O"):
            if kind == mode:
                done = 0
                if self._parts(pending, c):
                    frontier, done = self.FRESH, self._push(frontier, pending)[1]
                    pending = -1
                frontier, pending, count = self._read(frontier, pending, c)
                return (mode, frontier, pending), done + count
            done = self._close(key)
            to, count = self._move(self.keys[START], c)
            return to, done + count
        open_ = mode + c
        if open_ in self.contraction:
            return self.keys[START], self.contraction[open_]
        if any(x.startswith(open_) for x in CONTRACTIONS):
            return (open_, (), -1), 0
        if mode == "'":
            if kind == "O":  # a run of other signs that begins with the apostrophe
                frontier, pending, a = self._read(self.FRESH, -1, "'")
                frontier, pending, b = self._read(frontier, pending, c)
                return ("O", frontier, pending), a + b
            to, count = self._move(self.keys[START], c)
            return to, self._whole("'") + count
        first, a = self._move(self.keys[START], mode[1])
        to, b = self._move(first, c)
        return to, self._whole("'") + a + b

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Read text without white space: (state, tokens emitted)."""
        count, nexts = 0, self.next
        for c in text:
            step = nexts[state].get(c)
            if step is None:
                key, emitted = self._move(self.keys[state], c)
                step = nexts[state][c] = (self.state(key), emitted)
            state, emitted = step
            count += emitted
        return state, count

    def end(self, state: int) -> int:
        if self.ends[state] is None:
            self.ends[state] = self._close(self.keys[state])
        return self.ends[state]

    def word(self, word: str) -> int:
        """Tokens of a whole stretch between white space."""
        if len(self.keys) > MAX_STATES:
            self._clear()
        state, count = self.run(START, word)
        return count + self.end(state)

    # -- chunk state maps -------------------------------------------------------
    def normalise(self, text: str) -> list[str]:
        """Words of a text without special strings: NFC, each sign's lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return text.split() if not NOT_SPACE.search(text) else [w for w in SPACES.split(text) if w]

    def count_words(self, words: list[str]) -> int:
        """Tokens of words. Counts are kept for two generations of words: one that is
        met again moves to the young one, so rare words go and frequent ones stay."""
        memo = self.words
        missing = set(words).difference(memo)
        if missing:
            if len(memo) + len(missing) > MAX_WORDS:
                self.old, self.words = memo, {}
                memo, missing = self.words, set(words)
            long = [w for w in missing if len(w) > MAX_WORD_CHARS]
            for w in missing:
                if w not in memo:  # else the letters of a word met just before
                    k = w.rstrip(PUNCTUATION)
                    if k and k != w and k[-1].isalpha():  # between a letter and such a sign a word always ends
                        memo[w] = self._known(k, long) + self._known(w[len(k):], long)
                    else:
                        self._known(w, long)
            total = sum(map(memo.__getitem__, words))
            for w in long:
                memo.pop(w, None)
            return total
        return sum(map(memo.__getitem__, words))

    def _known(self, word: str, long: list[str]) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.old.get(word)
            n = self.words[word] = self.word(word) if n is None else n
            if len(word) > MAX_WORD_CHARS:
                long.append(word)
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if "<" not in text:
            return self.count_words(self.normalise(text))
        parts = self.special.split(text)
        return sum(self.count_words(self.normalise(p)) for p in parts[::2]) + len(parts) // 2

    def _forgets(self, before: str, c: str) -> bool:
        """Whether the state after ``before`` and c is that after c at a word's start,
        whatever came before: a word ends between them, or no token reaches over."""
        a, b = self._kind(before), self._kind(c)
        if a == "N" or b == "N":
            return True
        if before == "'":
            return False  # it may open a contraction
        if a != b:
            return True
        if c == "'" or b == "L" and c.isascii():
            return False  # such a letter may end a contraction
        return self._parts(before.encode("utf-8", "surrogatepass")[-1], c)

    def _meets(self, letters: str) -> tuple[int, tuple] | None:
        """For letters within a word of which the begin is unknown: (signs read, key) from
        which on all encodings are the same; None if they never meet.

        For each end of a prefix: the tokens that may be the last of its encoding, those
        that may follow a token that may be the last before them. Where only one is left at
        ``longest`` ends in a row, and the encodings that these end go back to one common
        place, the frontier follows from what stands after that place."""
        data = letters.encode("utf-8", "surrogatepass")
        signs, ends = 0, {}  # number of signs up to each byte that ends one
        for k in range(len(data)):
            if k + 1 == len(data) or data[k + 1] & 0xC0 != 0x80:
                signs += 1
                ends[k + 1] = signs
        reach = self.longest
        found: dict[int, list[tuple[int, int]]] = {}  # end -> (begin, token)
        last: dict[int, list[int] | None] = {}        # end -> tokens; None: any
        back: dict[int, int] = {}                     # end -> begin of the only token
        since = 0                                     # all ends from here on have one token
        for at in range(len(data)):
            here = found.pop(at, [])
            if at < reach:
                last[at], since = None, at + 1
            else:
                may = [(b, t) for b, t in here if last[b] is None or any(self._follows(p, t) for p in last[b])]
                last[at] = [t for _, t in may]
                if len(may) == 1:
                    back[at] = may[0][0]
                else:
                    since = at + 1
            last.pop(at - reach - 1, None)
            if at - since > reach and at % reach == 0 and at + 1 in ends:
                open_ = set(range(at - reach, at + 1))
                while len(open_) > 1 and (k := max(open_)) in back and back[k] >= since:
                    open_.remove(k)
                    open_.add(back[k])
                if len(open_) == 1 and (a := open_.pop()) >= since:
                    token = next(t for t, n in self._ending(data, a) if a - n == back[a])
                    frontier = ((0, token, 0),)
                    for b in data[a:at]:
                        frontier, _ = self._push(frontier, b, within=True)
                    return ends[at + 1], ("L", frontier, data[at])
            node = 0
            for e in range(at, min(at + reach, len(data))):
                node = self.trie[node].get(data[e], -1)
                if node < 0:
                    break
                if self.token[node] >= 0:
                    found.setdefault(e + 1, []).append((at, self.token[node]))
        return None

    def _ending(self, data: bytes, end: int):
        """(token, length) of the tokens that end at ``end``."""
        for n in range(1, min(self.longest, end) + 1):
            node = 0
            for b in data[end - n:end]:
                node = self.trie[node].get(b, -1)
                if node < 0:
                    break
            if node > 0 and self.token[node] >= 0:
                yield self.token[node], n

    def _stretch(self, word: str) -> tuple[str, int, int, str]:
        """The map of signs without white space."""
        at, key = 0, None
        for k in range(1, len(word)):
            if self._forgets(word[k - 1], word[k]):
                at, key = k + 1, self._move(self.keys[START], word[k])[0]
                break
        if key is None or at > 8 * self.longest:
            begin = 2 if word[0] == "'" else 1  # a contraction may end, or a word begin, before it
            letters = word[begin:at or len(word)]
            if letters and all(self._kind(c) == "L" for c in letters) and (met := self._meets(letters)):
                at, key = begin + met[0], met[1]
        if key is None:
            return word, NEVER, 0, ""
        if len(self.keys) > MAX_STATES:
            self._clear()
        state, count = self.run(self.state(key), word[at:])
        return word[:at], KNOWN, count, self._dump(state)

    def chunk_map(self, text: str) -> tuple[str, int, int, str]:
        """What a chunk does to any state: (head, how, count, key).

        ``head`` is to be read from the state before the chunk: what stands before the
        first white space or special string (``how`` is ENDS: there the word ends), or
        before that the signs up to a place from which on the state is KNOWN. Then come
        ``count`` tokens, and the state ``key``, whatever came before."""
        parts = self.special.split(text)
        whole = ("", NEVER, 0, "")
        start = self._dump(START)
        for k, part in enumerate(parts):
            if k % 2:
                whole = self.compose(whole, ("", ENDS, 1, start))
                continue
            words = self.normalise(part)
            lead = not words or bool(SPACES.match(part))
            trail = bool(words) and bool(SPACES.match(part[-1]))
            if lead and part:
                whole = self.compose(whole, ("", ENDS, 0, start))
            elif words:
                whole = self.compose(whole, self._stretch(words.pop(0)))
                if words or trail:
                    whole = self.compose(whole, ("", ENDS, 0, start))
            if words:
                tail = "" if trail else words.pop()
                if len(self.keys) > MAX_STATES:
                    self._clear()
                state, count = self.run(START, tail)
                key = self._dump(state)  # before other words may clear the table
                whole = self.compose(whole, ("", ENDS, self.count_words(words) + count, key))
        return whole

    def _dump(self, state: int) -> str:
        return json.dumps(self.keys[state])

    def _load(self, key: str) -> int:
        mode, frontier, pending = json.loads(key)
        return self.state((mode, tuple(map(tuple, frontier)), pending))

    def compose(self, a: tuple, b: tuple) -> tuple[str, int, int, str]:
        """The map that does a, then b. Associative; ("", NEVER, 0, "") is neutral."""
        if a[1] == NEVER:
            return a[0] + b[0], b[1], a[2] + b[2], b[3]
        if len(self.keys) > MAX_STATES:
            self._clear()
        state, count = self.run(self._load(a[3]), b[0])
        if b[1] != NEVER:
            return a[0], a[1], a[2] + count + (self.end(state) if b[1] == ENDS else 0) + b[2], b[3]
        return a[0], a[1], a[2] + count, self._dump(state)

    def finish(self, m: tuple) -> int:
        """Tokens of a whole text whose map is m."""
        _, _, count, key = self.compose(("", ENDS, 0, self._dump(START)), m)
        return count + self.end(self._load(key))


@lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """One per Python worker."""
    return Transducer(path)
