import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from repograph.llm import mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            break
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in sizes}


def test_taken(docs, doc_rows):
    got = mixing.taken(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in doc_rows)
    sizes = defaultdict(int)
    for r in doc_rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)


def test_reruns_agree_however_rows_lie(docs):
    key = lambda df: sorted(((r.doc_id, r.size, r.taken) for r in df.collect()), key=repr)
    assert key(mixing.taken(docs)) == key(mixing.taken(docs.repartition(3)))


def test_mixture_text_is_the_documents_words(docs, doc_rows):
    texts = defaultdict(set)
    for r in doc_rows:
        texts[r[0]].add(tuple((r[1] or "").split()))
    _, _, mixture = mixing.pieces(docs, block=16)
    for r in mixing.with_text(mixture, docs).where("doc_id is not null and source <> 'long'").collect():
        assert any(list(w[r.word : r.word + r.n_words]) == r.text.split(" ") for w in texts[r.doc_id])


def test_mixed_documents_hold_what_is_taken(docs):
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    got = mixing.mixed(docs).collect()
    assert got[0].__fields__ == docs.columns
    assert words(got) == sum(r.taken for r in mixing.taken(docs).collect())
    assert all(r.n_chars == len(r.text) for r in got)


def sources_of(spark, sizes):
    rows = [(s, n, 1.5 * n) for s, n in sizes.items()]
    return spark.createDataFrame(rows, "source string, source_size long, target double")


@pytest.mark.parametrize("shard_blocks", [3, 10, 4096])
def test_shards_have_a_fixed_size_and_mix_by_draws(spark, shard_blocks):
    sizes = {"a": 700, "b": 300, None: 90, "c": 1}
    runs = mixing.draws(sources_of(spark, sizes), block=1, shard_blocks=shard_blocks).collect()
    slots = {s: mixing.slots_of(n, 1.5 * n, 1, s, mixing.SEED)[0] for s, n in sizes.items()}
    total, by, of = sum(slots.values()), defaultdict(int), defaultdict(list)
    for r in runs:
        by[r.shard] += r["count"]
        of[r.source].append((r.shard, r.first, r["count"]))
    assert [by[k] for k in sorted(by)] == [shard_blocks] * (total // shard_blocks) + [total % shard_blocks] * (total % shard_blocks > 0)
    for s, parts in of.items():  # each slot once, in the order of shards
        end = 0
        for _, first, n in sorted(parts):
            assert first == end
            end += n
        assert end == slots[s]
    if shard_blocks == 10:  # as multinomial draws vary, without replacement
        n = total // 10
        drawn = {k: 0 for k in range(n)} | {k: c for k, _, c in of["a"] if k < n}
        p = slots["a"] / total
        assert abs(np.mean(list(drawn.values())) - 10 * p) < 0.5
        assert 0.6 < np.var(list(drawn.values())) / (10 * p * (1 - p)) < 1.5
    again = mixing.draws(sources_of(spark, sizes).repartition(3), block=1, shard_blocks=shard_blocks).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, runs))


def test_draw_beyond_the_librarys_limit():
    rng, left = np.random.default_rng(1), np.array([2 * 10**9, 10**9, 3, 0])
    got = mixing.draw(rng, left, 10**9)
    assert got.sum() == 10**9 and (got <= left).all() and abs(got[0] / 10**9 - 2 / 3) < 1e-3
    assert (mixing.draw(rng, left, int(left.sum())) == left).all()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000])
def test_permutation(n):
    p = mixing.permute(np.arange(n), n, 99)
    assert sorted(p) == list(range(n))
    assert (mixing.permute(p, n, 99, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("size", [1, 7, 128, 129, 1000])
def test_slots_give_the_target(size):
    for target in range(0, 2 * size + 1):
        k, last = mixing.slots_of(size, target, 128, "s", 1)
        n, got = -(-size // 128), 0
        for j in range(k):
            number = int(mixing.permute([j % n], n, mixing._key("s", j // n, 1))[0])
            block = min(128, size - number * 128)
            got += min(block, last) if j == k - 1 else block
        assert got == target


def test_empty(no_docs):
    assert mixing.taken(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0


def test_no_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.taken(df).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
