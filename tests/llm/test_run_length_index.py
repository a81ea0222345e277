"""The run-length index against brute force: marks, the order of suffixes, alphabets of any size, and no search in a step."""

import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup, textblocks


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


@pytest.mark.parametrize("size", [1, 63, 64, 65, 128, 1000])
def test_marks_count_what_stands_before(size):
    rng = random.Random(size)
    for n in {1, -(-size // 3), size}:
        at = np.array(sorted(rng.sample(range(size), n)))
        got = suffix_dedup.Marks(at, size).before(np.arange(size + 1))
        assert got.tolist() == [int((at < x).sum()) for x in range(size + 1)]


@pytest.mark.parametrize("alphabet", [1, 2, 62, 127, 256])
@pytest.mark.parametrize("bits", [63, 0])
def test_suffixes_are_in_order(monkeypatch, alphabet, bits):
    monkeypatch.setattr(suffix_dedup, "_SORT_BITS", bits)
    rng = random.Random(alphabet)
    texts = [bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(20)]
    texts += [texts[0], texts[1][:30], bytes(range(alphabet)), b"\x00" * 70]
    index = suffix_dedup.RunLengthIndex(*joined(texts), 5, most=50)
    text = [int(c) for t in texts for c in [*index.symbol[list(t)], 0]]
    assert index._sort(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("alphabet", [1, 2, 127, 256])
@pytest.mark.parametrize("bits", [63, 0])
@pytest.mark.parametrize("depth", [1, 9, 50, 70])
def test_marks_of_matches_in_any_alphabet(monkeypatch, alphabet, bits, depth):
    monkeypatch.setattr(suffix_dedup, "_SORT_BITS", bits)
    rng = random.Random(depth)
    draw = lambda n: bytes(rng.randrange(alphabet) for _ in range(n))
    known = [draw(rng.randint(1, 150)) for _ in range(12)]
    asked = [known[3][2:] + b"\xfe\xff" + known[5], draw(200), known[7], known[0] + known[1], b"\xff" * 80]
    owner = np.array([rng.randrange(100) for _ in known])
    marks, at = suffix_dedup.mark_matches(*joined(known), owner, *joined(asked), depth), 0
    for t in asked:
        for i in range(len(t)):
            has = [o for o, x in zip(owner.tolist(), known) if len(t) - i >= depth and t[i : i + depth] in x]
            assert marks[at + i] == min(has, default=suffix_dedup.NONE)
        at += len(t)


def test_a_step_searches_no_runs(monkeypatch):
    """Rows find their run, the nearest run of a byte and the group of their owner by counts: only the number of texts still streamed is searched."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcd") for _ in range(100)) for _ in range(50)]
    sought, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *k: sought.append(np.size(v)) or search(a, v, *k))
    marks = suffix_dedup.mark_matches(*joined(texts), np.arange(50), *joined(texts[::-1]), 50)
    assert len(sought) == 100 and set(sought) == {1}
    assert marks[0] == 49


def test_marks_follow_the_runs_too():
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(3000))
    many = suffix_dedup.RunLengthIndex(*joined([base[i % 40 :] for i in range(40)]), 50, most=50)
    parts = vars(many).values()
    arrays = sum(x.nbytes for x in parts if isinstance(x, np.ndarray)) + sum(r.nbytes for _, r in many.ranks)
    assert arrays + sum(x.nbytes for x in parts if isinstance(x, suffix_dedup.Marks)) < 30 * many.size


@pytest.mark.parametrize("length", [0, 5, 19, 20, 21, 500])
def test_hashes_of_following_bytes(length):
    data = np.random.default_rng(length).integers(0, 256, length).astype(np.uint8)
    c, n = textblocks.prefix_hashes(data), max(0, length - 19)
    assert np.array_equal(textblocks.next_hashes(c, n, 20), textblocks.range_hashes(c, np.arange(n), np.arange(n) + 20))
