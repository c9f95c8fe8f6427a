"""Personal data by candidate gradient boosting. Native: DataFrame functions only.

High-recall generators propose spans, overlapping ones too. Base kinds are checked
by their format (parts of an address, digits of a number, check digit) and always
stay. Candidates of the wide generators get features of their format and context.
Those that overlap a base span are known positives; the others are unlabelled, personal
or not. Boosted trees, fitted on all candidates, tell known from unlabelled. All candidates
calibrate too, each by trees fitted on the half that it isn't in: where those give the known
ones c on average, an unlabelled candidate with score p is personal with probability
(1 - c) / c * p / (1 - p) (Elkan and Noto, 2008), and the threshold is the least above which
a share PRECISION of the unlabelled is personal, in expectation. Those are added. The trees
are one SQL expression.

The fit reads no sample: a feature's cuts are quantiles of all its values, and candidates
with the same bins are one row with their numbers. Boosting asks only for sums by feature
and bin. Up to DRIVER such rows they come from arrays on the driver, beyond it each level
of a tree is a job. Sums and scores are whole numbers, so both give the same trees.

Positions come without a Python function: splitting a text by a pattern gives the
parts around its matches, and a running sum of lengths over (document, kind) gives
each match's place in code points. Texts stay in the scan's stage; only candidates
with a little context are shuffled, by document, so a text's size or a hot source
doesn't matter.

Defined cases: a null text is empty; documents without a candidate have empty
spans; repeated rows give repeated results; a half without both labels adds
nothing; an empty table gives an empty result; other columns are ignored. Results don't
depend on how rows lie: a candidate's half is by what it is, not by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repograph.llm.common import discard, written

_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base kinds in order. Each finds the same matches as its contract's pattern: a match
#: starts where a run starts, or where the last match ended, and runs are taken whole,
#: so that no text makes the search quadratic. Repeated groups are possessive: the search
#: walks those in a loop, others by recursion, which a long text would exhaust.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The wide generators.
WIDE = {
    "digits": r"(?<![0-9])[0-9]{7,19}+(?![0-9])",
    "number": r"\(?[0-9](?:[().\x20/-]{0,2}[0-9]){6,18}",
    "mail": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{_NAME}++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{_NAME}++)*+",
}
#: A text without these characters has no match: spares the search.
HINT = {"email": "@", "phone": "+", "mail": "at"}
CONTEXT = 24
CUES = r"(?i)(tel|phone|fon|call|mobil|fax|card|karte|carte|tarjeta|iban|konto|account|ssn|mail|contact)"
#: Trees, their step, rows of a leaf at least, the score of a leaf at most, cuts of a feature (bins take four bits).
TREES = 24
STEP = 0.3
LEAF = 5
MOST = 4
CUTS = 15
#: Whole numbers for one: of scores, of probabilities.
UNIT = 1 << 10
ONE = 1 << 20
#: Rows of equal bins that are summed on the driver; more are summed by jobs.
DRIVER = 100_000
#: Share of the added ones that must be right, in expectation.
PRECISION = 0.95
FEATURES = ("n_digits", "n_chars", "n_gaps", "n_dots", "n_parens", "n_dashes", "cue", "word_before", "word_after", "luhn", "generator", "first")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10),
    )
    able = F.length(digits).between(13, 19)
    return F.when(able, F.aggregate(F.when(able, each), F.lit(0), lambda a, v: a + v) % 10 == 0).otherwise(F.lit(False))


def _parts(kind: str, pattern: str) -> Column:
    """The parts around the matches, each with the match that follows it (null at the end)."""
    text = F.col("text")
    hint = F.contains(text, F.lit(HINT[kind])) if kind in HINT else F.lit(True)
    if kind == "mail":
        hint = hint | F.contains(text, F.lit("@"))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    each = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["p"]).cast("long").alias("gap"), z["m"].alias("match"),
            F.right(z["p"], F.lit(CONTEXT)).alias("before"), F.left(z["p"], F.lit(CONTEXT)).alias("head"),
        ),
    )
    return F.when(hint & F.regexp_like(text, F.lit(pattern)), each)


def candidates(docs: DataFrame) -> DataFrame:
    """A written table: doc_id, place (a key of the row), parts (of all kinds)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    all_parts = [_parts(k, p) for k, p in (BASE | WIDE).items()]
    none = F.array().cast("array<struct<kind: string, i: int, gap: bigint, match: string, before: string, head: string>>")
    found = text.select("doc_id", F.concat(*(F.coalesce(p, none) for p in all_parts)).alias("parts"))
    return written(found.withColumn("place", F.monotonically_increasing_id()), "parts")


def placed(found: DataFrame) -> DataFrame:
    """One row per candidate: doc_id, place, kind, start, stop, match, before, after."""
    each = found.select("doc_id", "place", F.explode("parts").alias("x")).select("doc_id", "place", "x.*")
    own = W.partitionBy("place", "kind").orderBy("i")
    size = F.col("gap") + F.coalesce(F.length("match"), F.lit(0))
    before = F.coalesce(F.sum(size).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.col("gap")
    after = F.coalesce(F.lead("head").over(own), F.lit(""))
    return each.select(
        "doc_id", "place", "kind", start.alias("start"), (start + F.length("match")).alias("stop"), "match", "before", after.alias("after")
    ).where("match is not null")


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    return (
        (kind == "email")
        | ((kind == "ip") & small)
        | ((kind == "card") & luhn(digits))
        | ((kind == "phone") & F.length(digits).between(9, 15))
    )


def spans(found: DataFrame) -> DataFrame:
    """Base spans that are valid, and wide candidates with features and the label `hit`
    (overlaps a base span). Overlap is told by two running extremes, not by pairs."""
    each = placed(found)
    base = F.col("kind").isin(*BASE)
    each = each.withColumn("base", base).where(~base | _valid(F.col("kind"), F.col("match")))
    order = W.partitionBy("place").orderBy("start", F.col("base").desc(), "stop", "kind")
    reach = F.max(F.when(F.col("base"), F.col("stop"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    # the next base span at or after this one's start: nearest is least
    following = F.min(F.when(F.col("base"), F.col("start"))).over(
        W.partitionBy("place").orderBy(F.col("start").desc(), "base", F.col("stop").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    hit = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("stop"), F.lit(False))
    m, digits = F.col("match"), _digits(F.col("match"))
    count = lambda chars: F.length(F.regexp_replace(m, f"[^{chars}]", ""))
    known = list(WIDE)
    values = {
        "n_digits": F.length(digits), "n_chars": F.length(m), "n_gaps": count(r"\x20"), "n_dots": count("."), "n_parens": count("()"),
        "n_dashes": count("/-"), "cue": F.regexp_like("before", F.lit(CUES)).cast("int"),
        "word_before": F.regexp_like("before", F.lit("[A-Za-z0-9]$")).cast("int"), "word_after": F.regexp_like("after", F.lit("^[A-Za-z0-9]")).cast("int"),
        "luhn": luhn(digits).cast("int"), "generator": F.array_position(F.lit(known), F.col("kind")).cast("int"),
        "first": F.coalesce(F.try_to_number(F.left(digits, F.lit(1)), F.lit("9")).cast("int"), F.lit(-1)),
    }
    # by what a candidate is
    half = F.pmod(F.xxhash64("doc_id", "kind", "start", "match", "before", "after"), F.lit(2)).cast("int")
    return each.select("place", "kind", "start", "stop", "base", hit.alias("hit"), half.alias("half"), *(F.when(~F.col("base"), values[f]).alias(f) for f in FEATURES))


def cuts(wide: DataFrame) -> list[list[int]]:
    """Each feature's quantiles over all candidates, at most CUTS: a candidate's bin is the number of cuts below its value."""
    each = wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("long").alias("v")) for i, c in enumerate(FEATURES)))).alias("x"))
    # as many values as the longest match is long at most, so a feature fits a window
    values = each.groupBy("x.f", "x.v").agg(F.count("*").alias("n"))
    own = W.partitionBy("f")
    values = values.select("f", "v", "n", F.sum("n").over(own).alias("all"), F.sum("n").over(own.orderBy("v")).alias("upto"))
    rank = lambda k: F.floor(k * (F.col("all") - 1) / (CUTS + 1))
    met = F.exists(F.sequence(F.lit(1), F.lit(CUTS)), lambda k: (rank(k) >= F.col("upto") - F.col("n")) & (rank(k) < F.col("upto")))
    out: list[list[int]] = [[] for _ in FEATURES]
    for r in values.where(met).select("f", "v").orderBy("f", "v").collect():
        out[r["f"]].append(r["v"])
    return out


def code(at: list[list[int]]) -> Column:
    """A candidate's bins in one number, four bits each."""
    bins = (sum(((F.col(c) > v).cast("long") for v in values), F.lit(0).cast("long")) for c, values in zip(FEATURES, at))
    return sum((F.shiftleft(b, 4 * i) for i, b in enumerate(bins)), F.lit(0).cast("long"))


def grouped(wide: DataFrame) -> DataFrame:
    """All candidates, one row for each code and half: hits and others."""
    return wide.groupBy("code", "half").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("others"))


def _bin(f: int) -> Column:
    return F.shiftright("code", 4 * f).bitwiseAND(F.lit(15).cast("long"))


def score(trees: list) -> Column:
    """Of the column code, in UNITs."""
    def node(f, b, low, high):
        return low if b == CUTS else F.when(_bin(f) <= b, low).otherwise(high)

    out = F.lit(0)
    for f, b, left, right in trees:
        out = out + node(f, b, *(node(*x[:2], F.lit(x[2]), F.lit(x[3])) for x in (left, right)))
    return out


def _on_driver(groups: DataFrame) -> tuple:
    """sums(trees, half or None, split or None): of the rows' numbers, gradients and curvatures by node, feature and
    bin, before a split or on its sides. tally(trees by half): (score by the other half's trees, hits, others)."""
    import numpy as np

    rows = np.array([tuple(r) for r in groups.select("code", "half", "hits", "others").collect()], dtype=np.int64)
    codes, half, hits, others = rows.T
    bins = [codes >> 4 * f & 15 for f in range(len(FEATURES))]

    def scores(trees):
        out = np.zeros(len(codes), np.int64)
        for f, b, left, right in trees:
            low, high = (np.where(bins[f2] <= b2, lo, hi) for f2, b2, lo, hi in (left, right))
            out += np.where(bins[f] <= b, low, high)
        return out

    def sums(trees, fold, split):
        p = np.rint(ONE / (1 + np.exp(scores(trees) / -float(UNIT)))).astype(np.int64)
        n = (hits + others) * (True if fold is None else half == fold)
        g = (hits * (ONE - p) - others * p) * (n > 0)
        h = n * (p * (ONE - p) // ONE)
        node = np.zeros_like(codes) if split is None else (bins[split[0]] > split[1]).astype(np.int64)
        out = np.zeros((2, len(FEATURES), CUTS + 1, 3), np.int64)
        for f, own in enumerate(bins):
            np.add.at(out[:, f], (node, own), np.stack([n, g, h], axis=1))
        return out

    def tally(trees):
        own = np.where(half == 0, scores(trees[1]), scores(trees[0]))
        found, where = np.unique(own, return_inverse=True)
        out = np.zeros((len(found), 2), np.int64)
        np.add.at(out, where, np.stack([hits, others], axis=1))
        return np.column_stack([found, out])

    return sums, tally


def _by_jobs(groups: DataFrame) -> tuple:
    """The same; a job sends at most 2 * features * bins rows, tally's one for each score (below 2 * MOST * TREES * UNIT)."""
    import numpy as np

    def sums(trees, fold, split):
        mine = groups if fold is None else groups.where(F.col("half") == fold)
        p = F.rint(ONE / (1 + F.exp(score(trees) / F.lit(-float(UNIT))))).cast("long")
        mine = mine.withColumn("p", p).withColumn("n", F.col("hits") + F.col("others"))
        g = F.col("hits") * (ONE - F.col("p")) - F.col("others") * F.col("p")
        h = F.col("n") * F.floor(F.col("p") * (ONE - F.col("p")) / ONE)
        node = F.lit(0) if split is None else (_bin(split[0]) > split[1]).cast("int")
        own = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), _bin(f).alias("b")) for f in range(len(FEATURES)))))
        each = mine.select(node.alias("node"), "n", g.alias("g"), h.alias("h"), own.alias("x"))
        out = np.zeros((2, len(FEATURES), CUTS + 1, 3), np.int64)
        for r in each.groupBy("node", "x.f", "x.b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[r["node"], r["f"], r["b"]] = r["n"], r["g"], r["h"]
        return out

    def tally(trees):
        own = F.when(F.col("half") == 0, score(trees[1])).otherwise(score(trees[0]))
        rows = groups.groupBy(own.alias("s")).agg(F.sum("hits").alias("hits"), F.sum("others").alias("others")).orderBy("s").collect()
        return np.array([tuple(r) for r in rows], dtype=np.int64)

    return sums, tally


def _split(table) -> tuple:
    """The best (feature, bin) to go left up to, or one that all go left by, from sums by feature and bin."""
    import numpy as np

    low = table.cumsum(axis=1)
    high = low[:, -1:] - low
    gain = lambda t: (t[..., 1] / ONE) ** 2 / (t[..., 2] / ONE + 1)
    now = np.where((low[..., 0] >= LEAF) & (high[..., 0] >= LEAF), gain(low) + gain(high), -1.0)
    none, best = gain(low[0, -1]), np.unravel_index(now.argmax(), now.shape)
    return tuple(map(int, best)) if now[best] > none + 1e-6 * (1 + none) else (0, CUTS)


def _leaf(sums) -> int:
    _, g, h = (int(x) for x in sums)
    return round(max(-MOST, min(MOST, STEP * g / (h + ONE))) * UNIT)


def boost(sums, half: int | None) -> list:
    """Trees of depth two over a half, or over all candidates: (feature, bin, left, right); left (up to that bin)
    and right are (feature, bin, low, high)."""
    trees: list = []
    for _ in range(TREES):
        f, b = _split(sums(trees, half, None)[0])
        tree = [f, b]
        for side in sums(trees, half, (f, b)):
            f2, b2 = _split(side)
            tree.append((f2, b2, _leaf(side[f2, : b2 + 1].sum(axis=0)), _leaf(side[f2, b2 + 1 :].sum(axis=0))))
        trees.append(tuple(tree))
    return trees


def threshold(tally) -> int | None:
    """Twice the least score to add, from (score, hits, others) of all candidates."""
    import numpy as np

    scores, known, others = tally[np.argsort(-tally[:, 0])].T
    p = np.clip(1 / (1 + np.exp(scores / -float(UNIT))), 1e-9, 1 - 1e-9)
    c = min((p * known).sum() / known.sum(), 1 - 1e-9)
    hidden = np.minimum(1, (1 - c) / c * p / (1 - p))
    unlabelled = np.cumsum(others)
    right = np.where(unlabelled > 0, np.cumsum(others * hidden) / np.maximum(unlabelled, 1), 1)
    good = np.nonzero(right >= PRECISION)[0]
    if not len(good):
        return None
    last = good[-1]
    return int(scores[last] + scores[min(last + 1, len(scores) - 1)])


def fit(groups: DataFrame) -> tuple[list, int] | None:
    """Trees fitted on all candidates, and twice the least score to add."""
    halves = groups.groupBy("half").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.sum("others").alias("others")).collect()
    if len(halves) < 2 or not all(r["hits"] and r["others"] for r in halves):
        return None
    sums, tally = (_on_driver if sum(r["n"] for r in halves) <= DRIVER else _by_jobs)(groups)
    least = threshold(tally([boost(sums, half) for half in (0, 1)]))
    return None if least is None else (boost(sums, None), least)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = candidates(docs)
    featured = written(spans(found), "spans")
    # written, as a score names the code many times
    each = written(featured.withColumn("code", code(cuts(featured.where(~F.col("base"))))).drop(*FEATURES), "codes")
    discard(featured)
    groups = written(grouped(each.where(~F.col("base"))), "groups")
    model = fit(groups)
    discard(groups)
    chosen = ~F.col("hit") & (score(model[0]) * 2 >= model[1]) if model else F.lit(False)
    kinds = F.create_map(*(F.lit(x) for i, k in enumerate([*BASE, *WIDE]) for x in (k, i)))
    said = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string"))
    item = F.struct(kinds[F.col("kind")].alias("k"), F.col("start"), F.col("base"), said.alias("said"))
    got = each.where(F.col("base") | chosen).groupBy("place").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.count_if(~F.col("base")).alias("n_added"),
    )
    met = found.select("doc_id", "place").join(got, "place", "left")
    base = F.coalesce(F.array_join(F.transform(F.filter("items", lambda i: i["base"]), lambda i: i["said"]), ","), F.lit(""))
    return met.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE),
        F.sha2(base, 256).alias("base_sha256"),
        F.coalesce(F.array_join("items.said", ","), F.lit("")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).alias("n_added"),
    )
