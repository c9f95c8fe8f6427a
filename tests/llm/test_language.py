import zlib
from collections import Counter

import pytest

from repograph.llm import langid


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = langid.predict(df).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_predictions_use_only_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df).collect()}
    other = df.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'xx' else lang end lang", "'s' source", "n_chars")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(other).collect()} == base


def test_awkward_rows(docs, doc_rows):
    got = langid.predict(docs).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    want = Counter((r[0], not any(map(str.isalpha, r[1] or ""))) for r in doc_rows)
    assert Counter((r.doc_id, r.lang_pred == "und") for r in got) == want
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_no_labels_and_empty(spark, no_docs):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(df).collect()] == ["und"]
    assert langid.predict(no_docs).count() == 0


def test_rows_kept_keep_their_columns(docs, doc_rows):
    got = langid.keep_known(docs)
    assert got.schema == docs.schema
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in doc_rows if any(map(str.isalpha, r[1] or "")))
    assert all(r.lang for r in rows)


def test_kernel_ridge_by_its_definition():
    """With every row a landmark and every n-gram known: scores as the dual solution over whole kernel matrices."""
    import numpy as np

    texts = ["the cat sat", "a cat ran off", "le chat noir", "la souris verte", "der hund lief", "die graue maus"]
    rows = list(zip(texts, ["en", "en", "fr", "fr", "de", "de"], strict=True))
    grams = lambda t: {t[i : i + n] for n in langid.LENGTHS for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    truth = np.array([[1.0 if la == r[1] else -1.0 for la in ("de", "en", "fr")] for r in rows])
    alpha = np.linalg.solve(k + langid.RIDGE * len(rows) / 100 * np.eye(len(rows)), truth)
    model = langid.fit(rows)
    asked = ["the black cat", "der schwarze hund", "une souris"]
    known = {g for t in texts for g in grams(t)}
    length = [len(grams(q) & known) ** 0.5 for q in asked]
    want = np.array([[len(grams(q) & grams(t)) / n / len(grams(t)) ** 0.5 for t in texts] for q, n in zip(asked, length, strict=True)]) @ alpha
    assert np.allclose(langid.Scorer(model)(asked), want, atol=1e-3)


def test_sample_is_bounded_and_has_every_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROWS", 12)
    rows = [(1, f"text {chr(97 + k % 26)}", f"l{k % 4}") for k in range(400)]  # all with one doc_id
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {la for _, la in got} == {f"l{k}" for k in range(4)} and len(got) <= 12


def test_symbols_beyond_the_first_planes_are_no_letters():
    assert [len(c) for c in langid.codes("　a😀b中")] == [len(" a b中") - n for n in range(4)]


def test_presence_matches_brute_force():
    import numpy as np

    rows = [("the cat sat on the mat", "en"), ("le chat est sur la table", "fr"), ("der hund und die katze", "de")] * 3
    model = langid.fit(rows)
    scorer = langid.Scorer(model)
    text = "The  cat, 12 und le..."
    grams = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" "))
    while "  " in grams:
        grams = grams.replace("  ", " ")
    wanted = set()
    for n in langid.LENGTHS:
        for i in range(len(grams) - n + 1):
            (c,) = [x for x in langid.codes(grams[i : i + n])[n - 1 : n]]
            wanted.add(int(c[0]))
    have = {int(k) for k, p in zip(model.keys, scorer.presence([text])[0], strict=True) if p}
    assert have == wanted & {int(k) for k in model.keys}
    assert np.isfinite(scorer([text])).all()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_short_texts(n):
    assert sum(len(c) for c in langid.codes("x" * n)) == sum(max(0, n - k + 1) for k in langid.LENGTHS)
