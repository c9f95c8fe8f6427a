import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from repograph.llm import packing


def fills(lengths, capacity=1024):
    """The lengths in each bin by the plan; checks offsets."""
    runs, bins = packing.plan(Counter(lengths), capacity)
    rank, table = Counter(), sorted(runs)
    content = defaultdict(list)
    for n in lengths:
        r = rank[n]
        rank[n] += 1
        (_, first, pieces, bin0, each, offset) = [t for t in table if t[0] == n and t[1] <= r < t[1] + t[2]][0]
        k = r - first
        content[bin0 + k // each].append((offset + k % each * n, n))
    assert set(content) == set(range(bins))
    for items in content.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return content


def best_fit_decreasing(lengths, capacity=1024):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    r = random.Random(seed)
    lengths = [min(1024, int(r.lognormvariate(r.choice([3, 5, 6]), 1)) + 1) for _ in range(r.choice([1, 7, 300, 1500]))]
    content = fills(lengths)
    large = [sum(3 * n > 1024 for _, n in items) for items in content.values()]
    assert max(large) <= 2
    assert len(content) <= max(best_fit_decreasing(lengths) * 1.02 + 1, -(-sum(lengths) // 1024))


def test_large_items_pair_as_often_as_can_be():
    assert len(fills([600, 424, 600, 424, 512, 512, 700, 342])) == 5
    assert len(fills([1024] * 5 + [512] * 7)) == 9
    assert len(fills([1] * 2049)) == 3


def test_pack_matches_the_tokenizer(docs, doc_rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    docs_of, at = defaultdict(list), defaultdict(list)
    for r in rows:
        docs_of[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length <= 4096
    for items in at.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 1024
    want = defaultdict(list)
    for i, text, *_ in doc_rows:
        want[i].append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    for i, lists in want.items():
        have = sorted((r.start, bytes(r.ids)) for r in docs_of[i])
        assert have == sorted((s, np.array(x[s : s + n], "<u4").tobytes()) for x in lists for s, n in packing.cut(len(x)))


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_empty(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_long_runs_of_spaces():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "a" + " " * 200_000 + "b"
    assert packing.Encoder()(text) == t.encode(text, add_special_tokens=False).ids
