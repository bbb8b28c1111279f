"""A lexicon trie intersected with Levenshtein automata, as one automaton that all words of a block step through at once.

A state is a set of (trie node, edits so far), deletions already taken, with the transpositions that wait for their second
letter and the longest stem passed.  States are made as words reach them and kept in a table, so a step of a block is one look-up
for each word that is still alive; most die within a few letters.
"""

from __future__ import annotations

import numpy as np

DEAD, START = 0, 1
#: States after which a new block starts a new table, to bound memory.
MOST_STATES = 1 << 16
_SIZE = 0x110000
_MARKS = "@$*!"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its small letter (where that is one), and whether it belongs to words, or only inside them."""
    small, word, mark = np.arange(_SIZE, dtype=np.uint32), np.ones(_SIZE, bool), np.zeros(_SIZE, bool)
    for c in range(0x20000):  # beyond, all count as letters
        x = chr(c)
        word[c] = x.isalnum()
        if len(low := x.lower()) == 1:
            small[c] = ord(low)
    mark[[ord(c) for c in _MARKS]] = True
    return small, word, mark


_LETTERS: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(small letters of all texts, each behind a line feed; starts and ends of words; where texts start).  A word is letters and
    digits, with up to two marks in a row inside."""
    if not _LETTERS:
        _LETTERS.append(_tables())
    small, word, mark = _LETTERS[0]
    letters = small[np.frombuffer("".join("\n" + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) + 1
    own = word[letters]
    marks = np.flatnonzero(mark[letters])
    if len(marks):
        n, inner, is_mark = len(letters), own.copy(), mark[letters]
        at = lambda x, i: x[np.clip(i, 0, n - 1)] & (i >= 0) & (i < n)
        near = lambda d: at(own, marks + d) | (at(is_mark, marks + d) & at(own, marks + 2 * d))
        inner[marks] = near(-1) & near(1)
        own = inner
    edge = np.diff(np.concatenate(([False], own, [False])).astype(np.int8))
    return letters, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), firsts


def edits_allowed(term: str) -> int:
    """Edits that leave a term of this length recognisable."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """Recognises words within the allowed edits (insertion, deletion, substitution, transposition) of a term, and any word that begins
    with a stem.  ``entries``: (text, whether it is a stem)."""

    def __init__(self, entries: list[tuple[str, bool]], edits: bool = True):
        self.entries = entries
        self.allowed = [edits_allowed(t) if edits and not stem else 0 for t, stem in entries]
        self.classes = {c: i + 1 for i, c in enumerate(sorted({c for t, _ in entries for c in t}))}
        self.class_of = np.zeros(_SIZE, np.uint16)
        for c, i in self.classes.items():
            self.class_of[ord(c)] = i
        self.children: list[dict[int, int]] = [{}]
        self.term_at, self.stem_at, self.reach = [-1], [-1], [0]
        for number, (text, stem) in enumerate(entries):
            node, allowed = 0, self.allowed[number]
            self.reach[0] = max(self.reach[0], allowed)
            for c in text:
                k = self.classes[c]
                if k not in self.children[node]:
                    self.children[node][k] = len(self.children)
                    self.children.append({})
                    for x, v in ((self.term_at, -1), (self.stem_at, -1), (self.reach, 0)):
                        x.append(v)
                node = self.children[node][k]
                self.reach[node] = max(self.reach[node], allowed)
            at = self.stem_at if stem else self.term_at
            if at[node] < 0:
                at[node] = number
        self._clear()

    def _clear(self) -> None:
        self.sets: list[tuple[frozenset, int]] = []
        self.number: dict[tuple[frozenset, int], int] = {}
        self.table = np.full((256, len(self.classes) + 1), -1, np.int32)
        self.found = np.full((256, 2), -1, np.int32)
        self._state(frozenset(), -1)  # DEAD
        self._state(self._closed({(0, 0, 0)}), -1)  # START

    def _closed(self, items: set) -> frozenset:
        """With deletions; of a node's items the one with the fewest edits."""
        best: dict[tuple[int, int], int] = {}
        todo = list(items)
        while todo:
            node, edits, waits = todo.pop()
            if edits > self.reach[node] or best.get((node, waits), 99) <= edits:
                continue
            best[node, waits] = edits
            if not waits:
                todo += [(child, edits + 1, 0) for child in self.children[node].values()]
        return frozenset((node, edits, waits) for (node, waits), edits in best.items())

    def _state(self, items: frozenset, stem: int) -> int:
        key = (items, stem)
        if key in self.number:
            return self.number[key]
        n = self.number[key] = len(self.sets)
        self.sets.append(key)
        if n == len(self.table):
            self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
            self.found = np.concatenate((self.found, np.full_like(self.found, -1)))
        if not items:
            self.table[n] = n  # nothing changes any more
        ends = [(edits, 1, t) for node, edits, waits in items if not waits and (t := self.term_at[node]) >= 0 and edits <= self.allowed[t]]
        if stem >= 0:
            ends.append((0, 2, stem))  # behind an exact term, before a misspelt one
        if ends:
            edits, _, entry = min(ends)
            self.found[n] = entry, edits
        return n

    def _step(self, state: int, c: int) -> int:
        items, stem = self.sets[state]
        out = set()
        for node, edits, waits in items:
            if waits:
                if waits == c:
                    out.add((node, edits, 0))
                continue
            next_of = self.children[node]
            if c in next_of:
                out.add((next_of[c], edits, 0))
            if edits < self.reach[node]:
                out.add((node, edits + 1, 0))
                for k, child in next_of.items():
                    out.add((child, edits + 1, 0))
                    if k != c and c in self.children[child]:
                        out.add((self.children[child][c], edits + 1, k))
        for node, edits, waits in out:
            if not edits and not waits and self.stem_at[node] >= 0:
                stem = self.stem_at[node]
        return self._state(self._closed(out), stem)

    def matches(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, entries, edits): the words that the lexicon recognises, in their order."""
        if len(self.sets) > MOST_STATES:
            self._clear()
        last = np.zeros(len(starts), np.int32)
        which, at, state = np.arange(len(starts)), starts.copy(), np.full(len(starts), START, np.int32)
        while len(which):
            c = self.class_of[letters[at]]
            after = self.table[state, c]
            if (new := np.flatnonzero(after < 0)).size:
                pairs, back = np.unique(state[new].astype(np.int64) * 65536 + c[new], return_inverse=True)
                to = np.zeros(len(pairs), np.int32)
                for i, pair in enumerate(pairs.tolist()):
                    to[i] = self._step(pair >> 16, pair & 65535)
                    self.table[pair >> 16, pair & 65535] = to[i]
                after[new] = to[back]
            at += 1
            last[which] = after
            on = (after != DEAD) & (at < ends[which])
            which, at, state = which[on], at[on], after[on]
        hit = np.flatnonzero(self.found[last, 0] >= 0)
        return hit, self.found[last[hit], 0], self.found[last[hit], 1]
