"""Longest match by the flat trie, and windows from seams, against encoding whole texts."""

import random

import numpy as np
import pytest

from quarry.functions.vocabulary import Vocabulary
from quarry.plans import windows


def random_vocabulary(rng, letters, n):
    tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)}
    return Vocabulary([f"{i} {t!r} {len(t)}" for i, t in enumerate(sorted(tokens))])


def greedy(v, data):
    out, p = [], 0
    while p < len(data):
        n = max(k for k in range(1, min(v.longest, len(data) - p) + 1) if data[p : p + k] in v.ids)
        out.append(v.ids[data[p : p + n]])
        p += n
    return out


@pytest.mark.parametrize("n", [0, 6, 400])
def test_all_places_step_through_the_trie_at_once(n):
    rng = random.Random(n)
    for _ in range(10):
        v = random_vocabulary(rng, b"abc\xc3\x00\xff", n)
        texts = [bytes(rng.choice(b"abc\xc3\x00\xffz") for _ in range(rng.randint(0, 90))) for _ in range(20)]
        for data, (ids, starts) in zip(texts, v.encode_all(texts), strict=True):
            assert ids.tolist() == greedy(v, data) == v.encode(data) and v.decode(ids.tolist()) == data
            assert starts.tolist() == np.cumsum([0, *(len(v.tokens[i]) for i in ids.tolist())])[: len(ids)].tolist()
    assert v.encode_all([]) == [] and v.encode(b"") == []


def test_blocks_do_not_join_texts(monkeypatch):
    from quarry.functions import vocabulary

    v = Vocabulary([*(f"{b} {bytes([b])!r} 1" for b in range(256)), "300 'ab' 2"])
    monkeypatch.setattr(vocabulary, "BLOCK", 5)
    assert [x.tolist() for x, _ in v.encode_all([b"a", b"b", b"", b"abab", b"a", b"bb"])] == [[97], [98], [], [300, 300], [97], [98, 98]]


def random_episode(rng, v):
    """An episode of short messages, its texts and pieces; the regions of neighbours are often equal."""
    word = lambda most: "".join(rng.choice("abcab\n") for _ in range(rng.randint(0, most)))
    n = rng.randint(1, 12)
    pieces = [(word(8), "tool_schema", 0.0, windows.TOOLS)]
    for m in range(n):
        pieces += [(word(rng.choice([1, 4, 30])), rng.choice(["user", "assistant_final", "system"]), 1.0, m) for _ in range(rng.randint(0, 3))]
    pieces.append((word(12), "user", 0.0, windows.CONTRACT))
    pieces = [(t.encode(), *rest) for t, *rest in pieces if t]
    buffer = b"".join(p[0] for p in pieces)
    ((ids, starts),) = v.encode_all([buffer])
    return n, pieces, windows.Episode(v, pieces, n, ids, starts, buffer)


def test_stretches_and_seams_equal_encoding_the_window():
    rng = random.Random(9)
    for _ in range(60):
        v = random_vocabulary(rng, b"abc\n", rng.choice([3, 40, 300]))
        n, pieces, e = random_episode(rng, v)
        for _ in range(25):
            at = rng.randrange(n)
            gone, p = [], rng.randint(0, 3)
            while p < at:
                last = min(p + rng.randint(0, 2), at - 1)
                gone.append((p, last))
                p = last + rng.randint(2, 4)
            contract = rng.random() < 0.5
            kept = {windows.TOOLS, *[windows.CONTRACT] * contract, *(m for m in range(at + 1) if not any(a <= m <= b for a, b in gone))}
            order = [p for p in pieces if p[3] in kept and p[3] == windows.TOOLS] + [p for p in pieces if p[3] in kept and p[3] == windows.CONTRACT] + [p for p in pieces if p[3] in kept and p[3] >= 0]
            runs = e.stretches(at, gone, contract)
            text = b"".join(p[0] for p in order)
            assert b"".join(e.buffer[a:b] for a, b in runs) == text
            ids = greedy(v, text)
            kinds = [(p[1], p[2] if p[3] == at else 0.0) for p in order for _ in p[0]]
            want, p = [], 0
            for i in ids:
                met = kinds[p : p + len(v.tokens[i])]
                # of equal regions side by side only the weight could differ
                want.append(met[0] if len(set(met)) == 1 else ("mixed_boundary", 0.0))
                p += len(v.tokens[i])
            assert e.size(runs) == len(ids) and e.size(runs) == len(ids)  # again, with the seams kept
            got = e.record(runs, at)
            assert got[0] == ids
            if all(a[3] == b[3] or a[1] != b[1] or a[3] != at and b[3] != at for a, b in zip(order, order[1:])):
                assert list(zip(got[2], got[1], strict=True)) == want


def test_windows_encode_little_more_than_the_text():
    """Sizes of all windows of a long episode take its text once and a few bytes for each seam."""
    rng = random.Random(4)
    v = random_vocabulary(rng, b"abcd ", 500)
    n = 400
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(200, 900))).encode() for _ in range(n)]
    pieces = [(t, "user" if i % 2 else "assistant_final", 1.0, i) for i, t in enumerate(texts)]
    buffer = b"".join(texts)
    ((ids, starts),) = v.encode_all([buffer])
    e = windows.Episode(v, pieces, n, ids, starts, buffer)
    seen, first = 0, v.first

    def counted(data):
        nonlocal seen
        seen += first(data)[0]
        return first(data)

    v.first = counted
    loose = [(i, i + 1) for i in range(2, n - 1, 2)]
    for at in range(0, n, 2):
        windows.fewest_dropped(e, {"at": at, "last_user": at - 1, "last_assistant": at - 2}, loose, [0] * (n + 1), True, 6000)
    assert seen < len(buffer)


def test_a_batch_of_episodes_is_handed_on_in_pieces(spark):
    """Records leave Python as they are made, with the columns of their episode, and are the same in any pieces."""
    from test_jobs import EPISODES, long_talk, vocabulary

    rows = [(f"{i:064d}", f"d{i}", "r", "train", "task:x", "t", True, "tort of the river", None, long_talk(3, i)) for i in range(4)]
    episodes, carried = spark.createDataFrame(rows, EPISODES), ("source_dataset", "success")
    found = windows.fitted(episodes, vocabulary(), 500, records=True, carried=carried)
    (batch,) = windows._pieced(episodes, None, carried).toArrow().combine_chunks().to_batches()
    v, kinds = windows.of_lines(tuple(vocabulary())), windows.to_arrow_schema(found.schema)
    each = list(windows.windows_of(iter([batch]), v, 500, True, carried, kinds, 100))
    assert len(each) > 4 and all(sum(map(len, b.column("ids").to_pylist()[:-1])) < 100 for b in each)
    plain = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
    made = sorted(plain(r.values()) for b in each for r in b.to_pylist())
    assert made == sorted(plain(r) for r in found.collect()) and {(r[0][-1], r[-2][1:]) for r in made} == {(str(i), str(i)) for i in range(4)}
