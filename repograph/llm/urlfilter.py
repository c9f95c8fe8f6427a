"""URL filter with link-graph propagation. Native: DataFrame functions only.

Rules decide first: a rule (host, path) fits its host and all subdomains when the
url's path starts with the rule's; the longest wins. Where no rule fits, the host's
rank decides: personalised PageRank over the host edges found in the pages' links,
once from trusted hosts along the links and once from blocked hosts against them.

Seeds are the hosts with pages that the rules allow (trusted) or block (distrusted),
each by the share of such pages. Each rank has mass 1 at the start; a host is blocked
when its distrust exceeds both its trust and FLOOR times an even share of the mass, where
what it is as a seed itself counts only with the majority of its pages. Ranks are iterated
until they change by less than TOLERANCE.

Defined cases: a null url or one without `://` has empty host and path and is
allowed (no rule, no rank); null html has no links; repeated pages count once each;
links within a host and malformed links are no edges; an empty table gives an empty
result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import attach, discard, written

#: (host, path, verdict) of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
#: Rounds end when four of them change the ranks of both sides by less in sum; what is left then is as small.
TOLERANCE = 1e-11
#: As many rounds reach TOLERANCE on every graph, as each shrinks the change by DAMPING at least. For the SQL; Spark stops by itself.
ROUNDS = math.ceil(math.log(TOLERANCE / 4) / math.log(DAMPING))
FLOOR = 0.5
#: Decimal places that ranks are compared in.
PLACES = 12
#: Links that one seat of a hub holds, and the most seats.
HUB = 10_000
SEATS = 1024


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. The rules are a list in the
    program; each is one comparison in the scan's own stage, so nothing is joined or shuffled."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # later, longer rules go around
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def located(pages: DataFrame, rules=RULES) -> DataFrame:
    at = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return at.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) host pairs of absolute links, and how many links there are."""
    links = pages.where(F.col("html").contains("://") | F.col("html").contains("//")).select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1)))).alias("to"),
    )
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    pairs = links.select("src", host_of(absolute).alias("dst"))
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def seeds(at: DataFrame) -> DataFrame:
    """host, side (t or d), share: of each host with pages that rules allow (t) or block (d), their share of its
    pages. A host may be on both sides."""
    n = at.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("fit.verdict") == "allow").alias("a"),
        F.count_if(F.col("fit.verdict") == "block").alias("b"),
    )
    each = F.explode(F.array(F.struct(F.lit("t").alias("side"), F.col("a").alias("k")), F.struct(F.lit("d").alias("side"), F.col("b").alias("k"))))
    return n.select("host", "n", each.alias("x")).where("x.k > 0").select("host", "x.side", (F.col("x.k") / F.col("n")).alias("share"))


def ranks(edges: DataFrame, seed: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Both personalised PageRanks at once: side, host, rank, and own, the part of rank that the host's own share as
    a seed gives. edges (src, dst); seed (host, side, share).

    The sides share one loop as two components of one graph, (t, links) and (d, reversed
    links). Weight goes out evenly; a host without links out gives its weight back to the
    seeds, which the rounds' scaling to mass 1 does. Each round is one join by source and
    one aggregate with map-side sums; a table is written every fourth round and compared with
    the one before, and the rounds end when the two differ by less than tolerance. A hub's links
    are dealt over seats of HUB links each, and its rank goes to each of them, so no task gets all of them.
    """
    node = lambda side, host: F.concat(F.lit(side) if len(side) == 1 else F.col(side), F.col(host))
    arcs = edges.select(node("t", "src").alias("src"), node("t", "dst").alias("dst")).unionByName(
        edges.select(node("d", "dst").alias("src"), node("d", "src").alias("dst"))
    )
    arcs, seed = written(arcs, "arcs"), written(seed, "seeds")
    mass = {r["side"]: r["n"] for r in seed.groupBy("side").agg(F.sum("share").alias("n")).collect()}
    of_side = lambda known: F.create_map(*(F.lit(x) for s in ("t", "d") for x in (s, 1.0 / (known.get(s) or 1.0))))
    base = seed.select(node("side", "host").alias("node"), (of_side(mass)[F.col("side")] * F.col("share")).alias("base"))
    named = [F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 2)").alias("host")]
    total = arcs.count()
    if not total:
        return base.select(*named, F.col("base").alias("rank"), F.col("base").alias("own"))
    out = written(arcs.groupBy("src").agg(F.count("*").alias("degree")), "degrees")
    seats = F.least(F.ceil(F.col("degree") / HUB), F.lit(SEATS))
    steps = attach(arcs, out, "src", "degree", total, F.xxhash64("dst"))
    steps = written(steps.withColumn("seat", F.pmod(F.xxhash64("dst"), seats)), "steps")
    more = written(out.where(seats > 1).select("src", F.explode(F.sequence(F.lit(1).cast("long"), seats - 1)).alias("seat")), "seats")
    hubs = not more.isEmpty()
    rank = last = written(base.select("node", F.col("base").alias("rank")), "rank")
    k, change = 0, math.inf
    while change >= tolerance:
        have = rank.withColumnRenamed("node", "src")
        at = have.select("src", F.lit(0).cast("long").alias("seat"), "rank")
        if hubs:
            at = at.unionByName(more.join(have, "src").select("src", "seat", "rank"))
        sent = steps.join(at, ["src", "seat"]).select(F.col("dst").alias("node"), (F.col("rank") / F.col("degree") * damping).alias("rank"))
        new = sent.unionByName(base.select("node", (F.col("base") * (1 - damping)).alias("rank")))
        rank = new.groupBy("node").agg(F.sum("rank").alias("rank"))
        k += 1
        if k % 4 == 0:
            rank = written(rank, "rank")
            both = rank.unionByName(last.select("node", (-F.col("rank")).alias("rank"))).groupBy("node").agg(F.abs(F.sum("rank")).alias("by"))
            change = both.agg(F.coalesce(F.sum("by"), F.lit(0.0))).first()[0]
            discard(last)
            last = rank
    sums = {r["side"]: r["s"] for r in rank.groupBy(F.substring("node", 1, 1).alias("side")).agg(F.sum("rank").alias("s")).collect()}
    scale = of_side(sums)[F.substring("node", 1, 1)]
    own = F.coalesce("base", F.lit(0.0)) * (1 - damping)
    return rank.join(base, "node", "left").select(*named, (F.col("rank") * scale).alias("rank"), (own * scale).alias("own"))


def host_verdicts(edges: DataFrame, seed: DataFrame, **how) -> DataFrame:
    """host, trust, distrust, host_verdict, for the hosts with any rank.

    What links bring a host always speaks; what it has as a seed itself only if most of its pages are decided so:
    a rule for one path doesn't judge a host's other pages. Ranks are compared as rounded, so that reruns, whose
    sums differ in their last bits, agree."""
    side = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(0.0))
    speaks = F.col("rank") - F.when(F.coalesce("share", F.lit(0.0)) * 2 > 1, 0.0).otherwise(F.col("own"))
    got = ranks(edges, seed, **how).join(seed, ["side", "host"], "left").groupBy("host").agg(
        side("t", F.col("rank")).alias("trust"), side("d", F.col("rank")).alias("distrust"), side("t", speaks).alias("for"), side("d", speaks).alias("against")
    )
    got = written(got, "hosts")
    even = F.lit(round(FLOOR / max(1, got.count()), PLACES))
    against = F.round("against", PLACES)
    bad = (against > F.round("for", PLACES)) & (against > even)
    return got.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("host_verdict"))


def judge(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    at = located(pages, rules)
    known = host_verdicts(host_edges(pages), seeds(at), **how).where("host_verdict = 'block' or trust > 0 or distrust > 0")
    counts = at.groupBy("host").agg(F.count("*").alias("n"))
    known = written(known.join(counts, "host", "left").withColumn("n", F.coalesce("n", F.lit(0))), "known")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = attach(at, known, "host", "n", total, F.xxhash64("page_id", "path"))
    return met.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.col("host_verdict"), F.lit("allow")).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )
