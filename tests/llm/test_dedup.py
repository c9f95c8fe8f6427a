import hashlib
import re
from collections import Counter, defaultdict

import pytest

from repograph.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    low = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], low[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("limit", [exact_dedup.TABLE_BYTES, 2000])
def test_groups_match_brute_force(docs, doc_rows, limit):
    got = exact_dedup.dedup(docs, limit).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(doc_rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({norm(r[1]) for r in doc_rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_keep_first_keeps_whole_rows(docs, doc_rows):
    got = exact_dedup.keep_first(docs).collect()
    assert got[0].__fields__ == docs.columns
    assert len(got) == len({norm(r[1]) for r in doc_rows})
    assert {r.doc_id for r in got if r.doc_id is not None} <= {r.keep_id for r in exact_dedup.dedup(docs).collect()}


def test_empty(no_docs):
    assert exact_dedup.dedup(no_docs).count() == 0
    assert exact_dedup.keep_first(no_docs).count() == 0


def test_grace_spills_and_agrees():
    import random

    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(5000)]
    rows = [(t, int(hashlib.sha256(t).hexdigest()[:16], 16), i, 1, 1) for i, t in enumerate(texts)]
    got = {e[0]: (e[2], e[3]) for e in exact_dedup.grace(rows, limit=3000)}
    want = {}
    for i, t in enumerate(texts):
        low, n = want.get(t, (i, 0))
        want[t] = (low, n + 1)
    assert got == want


def test_full_hash_collisions_compare_contents():
    rows = [(f"t{i % 50}".encode(), 7, i, 1, 1) for i in range(500)]
    got = sorted((e[0], e[2], e[3]) for e in exact_dedup.grace(rows, limit=400))
    assert got == sorted((f"t{i}".encode(), i, 10) for i in range(50))
