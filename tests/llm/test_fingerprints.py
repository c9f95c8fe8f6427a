import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from repograph.llm import media, simhash


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    distinct = list(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            parent[f] = f = parent[parent[f]]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    return {f: root(f) for f in distinct}


def expected(rows):
    fps = [brute_fp(t) for _, t in rows]
    roots, low = brute_components(fps), {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            low[roots[f]] = min(i, low.get(roots[f], i))
    return Counter((i, f"{f:016x}", low.get(roots[f])) for (i, _), f in zip(rows, fps, strict=True))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_simhash(docs, doc_rows, crowd):
    short = [r for r in doc_rows if r[3] != "long"]
    got = simhash.near_duplicates(docs.where("source is null or source <> 'long'"), crowd).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected([r[:2] for r in short])


@pytest.mark.parametrize("crowd", [simhash.CROWD, 4])
def test_links_between_planted_fingerprints(spark, crowd):
    r = random.Random(2)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        fps.add(f)
        for _ in range(r.randint(0, 12)):  # chains of up to five changed bits, some links too long
            for b in r.sample(range(64), r.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {x.v: x.root for x in simhash.components(simhash.edges(df, crowd)).collect()}
    want = brute_components(fps)
    groups, have = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
        have[got.get(signed(f), signed(f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, have.values()))


def test_keep_first_keeps_one_of_each_component(docs):
    found = simhash.near_duplicates(docs).where("doc_id is not null").collect()
    got = {r.doc_id for r in simhash.keep_first(docs).where("doc_id is not null").collect()}
    assert got == {r.component_id for r in found}


def test_media_round_trip(docs, doc_rows):
    got = defaultdict(list)
    for r in media.media(docs).collect():
        got[r.doc_id].append(r)
    for i, text, *_ in doc_rows:
        data = (text or "").encode()
        pad = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        (r, *_) = [x for x in got[i] if x.payload_sha256 == hashlib.sha256(pad).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(pad), zlib.crc32(pad[-64:]))
        assert media.load(bytes(r.media)) == pad and r.media_bytes == len(r.media)
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert list(r.times) == sorted(r.times) and len(r.times) == len(r.codes)


def test_media_fingerprint_finds_a_tone():
    import numpy as np

    t = np.arange(8000)
    tone = (128 + 90 * np.sin(2 * np.pi * 1000 * t / 8000)).astype(np.uint8).tobytes()
    times, codes = media.fingerprint(tone)
    assert len(times) and Counter((c >> 12) for c in codes.tolist()).most_common(1)[0][0] == 64  # 1000 Hz
    again = media.fingerprint(tone)
    assert (again[0] == times).all() and (again[1] == codes).all()


def test_long_payload_in_parts_agrees():
    data = random.Random(1).randbytes(media.FRAME * (media.FRAMES_AT_ONCE + 5))
    whole = media.fingerprint(data)
    at_once, media.FRAMES_AT_ONCE = media.FRAMES_AT_ONCE, 64
    try:
        parts = media.fingerprint(data)
    finally:
        media.FRAMES_AT_ONCE = at_once
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_empty(no_docs):
    assert media.media(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
