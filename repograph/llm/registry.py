"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.llm import exact_dedup, langid, media, mixing, packing, pii, secret_scan, simhash, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of these tables, a source is an owner and its share in one language a repository (a null is a value of its own)."""
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, F.to_json(F.struct("source", "lang")), F.col("source"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media(_table(spark, sf_dir, "documents"), with_bytes=False)
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature().alias("feature")
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.archive(_table(spark, sf_dir, "pages")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_exact_dedup, op2_mix_sources, op3_secret_scan, op4_language_id, op5_media_columns,
        op6_url_filter, op7_pii, op8_pack, op9_warc, op10_simhash,
    )
    return {f.__name__: f for f in found}


def _url_filter_sql() -> str:
    """The ranks' rounds, one common table expression each."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}')"
    ordered = sorted(urlfilter.RULES, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=True)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + " END"
    d, rounds, places = urlfilter.DAMPING, urlfilter.ROUNDS, urlfilter.PLACES
    steps = "".join(
        f"""r{k} AS MATERIALIZED (SELECT side, host, sum(rank) AS rank FROM (
            SELECT e.side, e.dst AS host, r.rank / e.degree * {d} AS rank FROM e JOIN r{k - 1} r ON r.side = e.side AND r.host = e.src
            UNION ALL SELECT side, host, rank * (1 - {d}) FROM r0) x GROUP BY side, host),
        """
        for k in range(1, rounds + 1)
    )
    return rf"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
        l AS (SELECT page_id, {host("url")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
        p AS (SELECT *, {rule} AS rule, {said} AS fit FROM l),
        c AS (SELECT host, count(*) AS n, count(*) FILTER (fit = 'allow') AS a, count(*) FILTER (fit = 'block') AS b FROM p WHERE host <> '' GROUP BY host),
        s AS (SELECT 't' AS side, host, a * 1.0E0 / n AS share FROM c WHERE a > 0 UNION ALL SELECT 'd', host, b * 1.0E0 / n FROM c WHERE b > 0),
        k AS (SELECT {host("url")} AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1)) AS link FROM u),
        h AS (SELECT DISTINCT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM k),
        g AS (SELECT src, dst FROM h WHERE src <> '' AND dst <> '' AND src <> dst),
        b AS (SELECT 't' AS side, src, dst FROM g UNION ALL SELECT 'd', dst, src FROM g),
        e AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY side, src) AS degree FROM b),
        r0 AS MATERIALIZED (SELECT side, host, share / sum(share) OVER (PARTITION BY side) AS rank FROM s),
        {steps}
        o AS (SELECT side, host, rank * (1 - {d}) AS own FROM r0),
        q AS (SELECT r.side, r.host, r.rank / r.mass AS rank, (r.rank - CASE WHEN coalesce(s.share, 0) * 2 > 1 THEN 0 ELSE coalesce(o.own, 0) END) / r.mass AS says
              FROM (SELECT *, sum(rank) OVER (PARTITION BY side) AS mass FROM r{rounds}) r
              LEFT JOIN o ON o.side = r.side AND o.host = r.host LEFT JOIN s ON s.side = r.side AND s.host = r.host),
        v AS (SELECT host, sum(CASE WHEN side = 't' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN side = 'd' THEN rank ELSE 0 END) AS distrust,
                     round(sum(CASE WHEN side = 't' THEN says ELSE 0 END), {places}) AS pro, round(sum(CASE WHEN side = 'd' THEN says ELSE 0 END), {places}) AS con FROM q GROUP BY host),
        w AS (SELECT *, CASE WHEN con > pro AND con > round({urlfilter.FLOOR} / (SELECT count(*) FROM v), {places}) THEN 'block' ELSE 'allow' END AS verdict FROM v)
        SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.fit, w.verdict, 'allow') AS verdict, round(coalesce(w.trust, 0), 9) AS trust, round(coalesce(w.distrust, 0), 9) AS distrust
        FROM p LEFT JOIN w ON w.host = p.host"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": _url_filter_sql(),
        "op1_exact_dedup": r"""
            WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
            FROM n""",
        "op9_warc": """
            WITH n AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS b, sha256(coalesce(html, '')) AS h FROM pages),
            m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS low FROM n)
            SELECT page_id, b AS payload_bytes, h AS payload_digest,
                   CASE WHEN b >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN b >= 100 AND page_id <> low THEN low END AS refers_to
            FROM m""",
    }
