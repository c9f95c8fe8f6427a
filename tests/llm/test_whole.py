"""Results against the whole job: converged ranks, shifted payloads, whole texts."""

import pytest

from repograph.llm import langid, media, urlfilter


def test_ranks_are_converged_on_a_long_chain(spark):
    import numpy as np

    n, d = 24, urlfilter.DAMPING
    links = [(i + 1, i) for i in range(n - 1)] + [(i, i + 1) for i in range(0, n - 1, 5)]  # towards h0, which is blocked, and some back
    edges = spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in links], "src string, dst string")
    got = {r.host: r["rank"] for r in urlfilter.ranks(edges, spark.createDataFrame([("h0", "d", 0.4)], "host string, side string, share double")).collect()}
    step, seed = np.zeros((n, n)), np.eye(n)[0]
    for a, b in links:  # against the links
        step[a, b] = 1 / sum(b == y for _, y in links)
    want = np.linalg.solve(np.eye(n) - d * step, (1 - d) * seed)
    want /= want.sum()
    assert set(got) == {f"h{i}" for i in range(n)}
    assert all(got[f"h{i}"] == pytest.approx(want[i], abs=1e-9) for i in range(n))


def test_shifted_payloads_share_their_fingerprint():
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE length(text) > 7000 ORDER BY doc_id").fetchall()
    same, whole = 0, 0
    for (text,) in texts:
        data = text.encode()[:6000]
        a, b = (set(media.fingerprint(x)[1].tolist()) for x in (data, data[100:]))
        same, whole = same + len(a & b), whole + len(a | b)
    assert texts and same > 0.4 * whole


def test_fingerprint_by_its_definition():
    """Peaks of each frame by a Fourier sum, and all pairs of them, sample by sample."""
    import numpy as np

    data = np.random.default_rng(1).integers(0, 256, 1500).astype(np.uint8).tobytes()
    n = media.FRAME
    window, k = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]), np.arange(1, n // 2 + 1)
    wave = np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)
    peaks = []
    for begin in range(0, len(data), media.HOP):
        x = np.zeros(n)
        part = data[begin : begin + n]
        x[: len(part)] = list(part)
        loud = sorted(zip(-np.abs(wave @ ((x - x.mean()) * window)), k.tolist(), strict=True))
        first = loud[0][1]
        second = next(b for _, b in loud if abs(b - first) > 1)
        peaks.append((first, second))
    want = []
    for t, own in enumerate(peaks):
        want.append((t, own[0] << 12 | own[1] << 3))
        for gap in (1, 2):
            later = t + gap * n // media.HOP
            if later < len(peaks):
                want += [(t, a << 12 | b << 3 | gap) for a in own for b in peaks[later]]
    times, codes = media.fingerprint(data)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == sorted(want)


def test_short_payloads_have_a_fingerprint():
    for text in ("a", "some words", "x" * 63 + "y" * 200):
        assert len(media.fingerprint(media.padded(text.encode()))[1])
    assert not len(media.fingerprint(bytes(64))[1])


def test_pairs_reach_all_peaks_of_the_later_frames():
    import numpy as np

    t = np.arange(8000)
    two = (128 + 60 * np.sin(2 * np.pi * 1000 * t / 8000) + 40 * np.sin(2 * np.pi * 2500 * t / 8000)).astype(np.uint8).tobytes()
    assert {(64, 64), (64, 160), (160, 64), (160, 160)} <= {(c >> 12, c >> 3 & 511) for c in media.fingerprint(two)[1].tolist()}


def test_fit_reads_whole_texts():
    import random

    r = random.Random(3)
    words = {la: ["".join(r.choice(a) for _ in range(5)) for _ in range(200)] for la, a in (("en", "thernads"), ("fr", "loiqxuzc"))}
    say = lambda la, n: " ".join(r.choice(words[la]) for _ in range(n))
    header = "9 " * 2000  # no letter in the first 3,000 characters
    model = langid.fit([(header + say(la, 400), la) for la in words for _ in range(20)])
    scores = langid.Scorer(model)([say(la, 50) for la in words])
    assert [model.languages[k] for k in scores.argmax(1)] == list(words)


def test_fit_knows_every_language():
    texts = [(chr(0x4E00 + 7 * k) * 9 + " " + chr(0x4E01 + 7 * k) * 9, f"l{k:03d}") for k in range(320)]
    model = langid.fit(texts)
    scores = langid.Scorer(model)([t for t, _ in texts])
    assert [model.languages[k] for k in scores.argmax(1)] == [la for _, la in texts]
