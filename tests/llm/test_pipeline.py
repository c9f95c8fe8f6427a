
import corpus_pipeline

from tests.llm.test_dedup import norm
from tests.llm.test_fingerprints import brute_components, brute_fp


def test_stages_against_brute_force(spark, doc_rows, tmp_path):
    rows = list({r[0]: r for r in doc_rows if r[0] is not None}.values()) + [(None, "only here and nowhere else", "en", None)]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        assert name == "packing" or docs.columns == df.columns
    want = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    assert {r.doc_id for r in seen["language ID"].collect()} == {r[0] for r in want}
    first = {}
    for r in sorted(want, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(r[1]), r)
    assert {r.doc_id for r in seen["exact dedup"].collect()} == {r[0] for r in first.values()}
    fps = {r[0]: brute_fp(r[1]) for r in first.values()}
    roots, low = brute_components(list(fps.values())), {}
    for i in sorted(fps, key=lambda i: (i is None, i or 0)):
        low.setdefault(roots[fps[i]], i)
    kept = {r.doc_id: r for r in seen["near dedup"].collect()}
    assert set(kept) == set(low.values())
    words = lambda t: len(t.split())
    total = sum(words(r.text) for r in kept.values())
    mixed = seen["mixing"].collect()
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * total) <= 20
    packed = seen["packing"].collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_columns_of_any_name_pass_and_stages_are_defined_on_odd_rows(spark, docs, no_docs):
    for table in (docs, no_docs):
        given = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, "").checkpoint()
            assert given.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, given, "").count() >= given.count() and (given.count() > 0) == (table is docs)


def test_run_gives_the_stages_result(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 1024
