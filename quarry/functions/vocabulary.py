"""Byte vocabularies: the longest token at each place, by a flat trie that all places of all texts step through at once."""

from __future__ import annotations

import ast

import numpy as np

#: Bytes of texts that are encoded together.
BLOCK = 1 << 18
_END = 256  # between texts; no token holds it


class Trie:
    """A double array: the child of the node in slot s by byte c is in slot base[s] + c, if check of that slot is s.

    Nodes of several children get stretches of slots behind each other; those of one child fill the gaps."""

    def __init__(self, tokens: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for token, number in tokens.items():
            node = 0
            for c in token:
                after = children[node].get(c)
                if after is None:
                    after = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = after
            value[node] = number
        bases, cursor = [0] * len(children), 2 * _END
        bases[0] = 1  # slots 1 .. 256; the root itself is in slot 0
        alone = []
        for node, own in enumerate(children):
            if len(own) == 1 and node:
                alone.append(node)
            elif own and node:
                low = min(own)
                bases[node] = cursor - low
                cursor += max(own) - low + 1
        taken = np.zeros(cursor + len(alone), bool)
        taken[: 2 * _END] = True
        for node, own in enumerate(children):
            if len(own) > 1 and node:
                taken[[bases[node] + c for c in own]] = True
        for node, slot in zip(alone, np.flatnonzero(~taken).tolist()):
            bases[node] = slot - next(iter(children[node]))
        slots = [0] * len(children)
        for node, own in enumerate(children):  # parents come before their children
            for c, child in own.items():
                slots[child] = bases[node] + c
        size = len(taken) + 2 * _END
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slots], self.value[slots] = bases, value
        for node, own in enumerate(children):
            for child in own.values():
                self.check[slots[child]] = slots[node]

    def longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, token) of the longest token at each place; 0 and -1 where there is none."""
        n = len(symbols)
        length, token = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        padded = np.append(symbols, np.uint16(_END))
        at, slot, depth = np.arange(n), np.zeros(n, np.int32), 0
        while len(at):
            child = self.base[slot] + padded[at + depth]
            on = self.check[child] == slot
            at, slot, depth = at[on], child[on], depth + 1
            ends = self.value[slot] >= 0
            length[at[ends]], token[at[ends]] = depth, self.value[slot[ends]]
            inside = at + depth < n
            if not inside.all():
                at, slot = at[inside], slot[inside]
        return length, token


class Vocabulary:
    """Tokens of lines ``id literal length``; encodes by the longest token at each place."""

    def __init__(self, lines: list[str]):
        self.ids: dict[bytes, int] = {}
        self.tokens: dict[int, bytes] = {}
        for line in lines:
            head, _, rest = line.partition(" ")
            literal, _, length = rest.rpartition(" ")
            token = ast.literal_eval(literal)
            token = token.encode() if isinstance(token, str) else token
            if not token or len(token) != int(length) or token in self.ids or int(head) in self.tokens:
                raise ValueError(f"bad vocabulary line {line!r}")
            self.ids[token], self.tokens[int(head)] = int(head), token
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("a vocabulary needs every single byte")
        self.longest = max(map(len, self.ids))
        # lengths worth trying, longest first, by a token's first two bytes
        by_start: dict[bytes, set[int]] = {}
        for token in self.ids:
            by_start.setdefault(token[:2], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in by_start.items()}
        self.trie: Trie | None = None

    def first(self, data: bytes) -> tuple[int, int]:
        """(length, id) of the longest token that data begins with."""
        for n in self.lengths.get(data[:2], ()):
            if n <= len(data) and (found := self.ids.get(data[:n])) is not None:
                return n, found
        return 1, self.ids[data[:1]]

    def encode(self, data: bytes) -> list[int]:
        return self.encode_all([data])[0][0].tolist()

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids and where they start."""
        self.trie = self.trie or Trie(self.ids)
        out, block, size = [], [], 0
        for i, data in enumerate(texts):
            block.append(data)
            size += len(data) + 1
            if size >= BLOCK or i == len(texts) - 1:
                out += self._block(block, size)
                block, size = [], 0
        return out

    def _block(self, texts: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        symbols, at, firsts = np.full(size, _END, np.uint16), 0, []
        for data in texts:
            symbols[at : at + len(data)] = np.frombuffer(data, np.uint8)
            firsts.append(at)
            at += len(data) + 1
        length, token = self.trie.longest(symbols)
        steps, out = length.tolist(), []
        for first, data in zip(firsts, texts, strict=True):
            starts, p, end = [], first, first + len(data)
            while p < end:
                starts.append(p)
                p += steps[p]
            places = np.array(starts, np.int64)
            out.append((token[places], places - first))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


_LISTED: dict[tuple[str, ...], Vocabulary] = {}


def of_lines(lines: tuple[str, ...]) -> Vocabulary:
    """The vocabulary of these lines; each Python worker keeps one."""
    if lines not in _LISTED:
        _LISTED.clear()
        _LISTED[lines] = Vocabulary(list(lines))
    return _LISTED[lines]
