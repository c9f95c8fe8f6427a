import hashlib
import re
from collections import defaultdict

import pytest

from repograph.llm import urlfilter, warc

PAGES = "page_id long, url string, html string, host string, n long, low long, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "d") for r in rows], PAGES).repartition(3)


BIG = "<p>" + "é" * 200 + "</p>"
ROWS = [
    (1, "http://a.net/x", BIG), (2, "https://A.Example.NET/en/1?q#f", BIG), (3, "http://w.example.com/de/", "<p>short</p>"),
    (4, "http://w.example.com", "<p>short</p>"), (5, "HTTP://x.org/fr/a", None), (6, None, ""), (7, "no scheme", BIG),
    (8, "ftp://u.v.org?x=/fr/", "y" * 99), (9, "http://y.org/fr", "y" * 99), (10, "http://z.fr/ü x\ny", "z" * 100), (11, "http://net/", "z" * 100),
    (12, "http://example.net/de/", "z" * 3_000_000), (13, "x://", "q"), (None, "http://n.net/", BIG), (1, "http://a.net/x", BIG),
]


def brute_location(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_ranks(edges, seeds, rounds=urlfilter.ROUNDS, d=urlfilter.DAMPING):
    out = {}
    for side in "td":
        share = {h: x for h, s, x in seeds if s == side}
        base = {h: x / sum(share.values()) for h, x in share.items()}
        nxt = defaultdict(list)
        for a, b in edges:
            nxt[a if side == "t" else b].append(b if side == "t" else a)
        rank = dict(base)
        if edges:
            for _ in range(rounds):
                new = defaultdict(float)
                for h in base:
                    new[h] += (1 - d) * base[h]
                for h, r in rank.items():
                    for to in nxt[h]:
                        new[to] += d * r / len(nxt[h])
                rank = new
        total = sum(rank.values()) or 1
        kept = 1 - d if edges else 1  # of a seed's base, in its own rank
        out |= {(side, h): (r / total, kept * base.get(h, 0) / total, share.get(h, 0)) for h, r in rank.items()}
    return out


def test_locations_and_rules(spark):
    got = {r.page_id: r for r in urlfilter.judge(pages(spark, ROWS)).collect()}
    for i, url, _ in ROWS:
        host, path = brute_location(url)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def link_rows():
    import random

    r = random.Random(4)
    hosts = [f"h{i}.{t}" for i in range(25) for t in ("net", "com", "org", "xyz")]
    rows = []
    for k in range(400):
        host = r.choice(hosts)
        part = "/fr/" if host.endswith("org") and k % 3 else "/p"
        to = " ".join(f'<a href="{r.choice(["http://", "//", "HTTPS://"])}{r.choice(hosts)}/p{k}">x</a>' for _ in range(r.randint(0, 3)))
        rows.append((k, f"http://{host}{part}{k}", to + '<a href="/rel">'))
    return rows


def test_ranks_match_brute_force(spark, monkeypatch):
    rows = link_rows()
    edges = set()
    for _, url, html in rows:
        for to in re.findall(r'href="((?:https?:)?//[^"]+)"', html, re.I):
            a, b = brute_location(url)[0], brute_location("x:" + to if to.startswith("//") else to)[0]
            if a != b:
                edges.add((a, b))
    by = defaultdict(list)
    for _, url, _ in rows:
        host, path = brute_location(url)
        by[host].append(brute_rule(host, path)[1])
    seeds = [(h, s, v.count(w) / len(v)) for h, v in by.items() for s, w in (("t", "allow"), ("d", "block")) if w in v]
    df = pages(spark, rows)
    at = urlfilter.located(df)
    assert {(r.src, r.dst) for r in urlfilter.host_edges(df).collect()} == edges
    monkeypatch.setattr(urlfilter, "HUB", 2)  # most hosts are hubs of several seats
    got = {(r.side, r.host): (r["rank"], r.own) for r in urlfilter.ranks(urlfilter.host_edges(df), urlfilter.seeds(at)).collect()}
    want = brute_ranks(edges, seeds)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k][:2], abs=1e-9) for k in want)
    hosts = {h for _, h in want}
    for r in urlfilter.judge(df).collect():
        if r.rule is None:
            t, b = (w[0] - w[1] * (w[2] * 2 <= 1) for w in (want.get((s, r.host), (0, 0, 0)) for s in "td"))
            assert r.verdict == ("block" if b > t and b > urlfilter.FLOOR / len(hosts) else "allow")


def brute_warc(rows):
    low = {}
    for i, _, html in rows:
        if i is not None:
            low[html or ""] = min(i, low.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and i != low.get(html or "", i)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", low[html or ""] if revisit else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, tmp_path):
    archives = warc.archive(pages(spark, ROWS))
    got = warc.read(archives, with_payload=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_warc(ROWS)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    warc.export(archives, str(tmp_path))
    assert sorted((tuple(r) for r in warc.read_files(spark, f"{tmp_path}/*.warc.gz").collect()), key=repr) == brute_warc(ROWS)


def test_bad_archives_are_told():
    good = warc.record(1, "http://a/", b"abc", hashlib.sha256(b"abc").hexdigest(), None, False)
    bad = warc.record(1, "http://a/", b"abc", hashlib.sha256(b"abd").hexdigest(), None, False)
    assert [r[2] for r in warc.records([good[:9], good[9:] + good])] == [b"abc", b"abc"]
    for stream in ([bad], [good[:-4]]):
        with pytest.raises(warc.BadRecord):
            list(warc.records(stream))


def test_empty(spark):
    none = pages(spark, [])
    assert urlfilter.judge(none).count() == 0
    assert warc.read(warc.archive(none)).count() == 0


def test_url_filter_sql_on_linked_pages(spark, tmp_path):
    import duckdb

    from repograph.llm import registry

    pages(spark, link_rows()).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.op6_url_filter(spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()["op6_url_filter"])
    assert sorted(tuple(r[n] for n in want.columns) for r in got if r.page_id % 2) == sorted(r for r in want.fetchall() if r[0] % 2)
    assert len({r.verdict for r in got if r.rule is None}) == 2
