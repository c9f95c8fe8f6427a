"""Mixing sources to target weights.

The words of a source, its documents in the order of a hash, are packed into
blocks of a fixed length (a source's last block may be short). A source's target
fixes how many block slots it fills. Output shards have a fixed number of slots and
draw the sources of these multinomially. Slot j of a source takes block perm(j), where perm is a
keyed pseudorandom permutation of its block numbers, another one for each pass
over the source; blocks are then joined by (source, number). A source's last slot
is cut so that the words it gives equal its target.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own, last in order; documents with equal doc_id are mixed as
separate documents; an empty table, or one without words, gives targets of 0;
columns other than doc_id, text and source are ignored by `pieces`, and pass through
`mixed` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repograph.llm.common import WORD, attach, whole, written

#: Words of a block, and blocks of an output shard.
BLOCK = 128
SHARD_BLOCKS = 4096
#: Parts that a range of shards is split into at once.
FAN = 32
#: Weights of the sources in order, repeating; share of all words; most passes over a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
SEED = 17


def words(text):
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 on in the order of source, null last: places in the parts of a sorted table, each
    added to what the parts before it hold. No task sees all sources."""
    laid = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    base, seen = [], 0
    for r in sorted(laid.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each part
        base += [F.lit(r["part"]), F.lit(seen)]
        seen += r["n"]
    before = F.create_map(*base)[part] if base else F.lit(0)
    return laid.withColumn("rank", before + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """sources (source, source_size, n_docs) with target: what is shared out by weight, none above most times
    its size. Capping and sharing the excess again is repeated on one aggregate row until none is above."""
    table = [float(w) for w in weights]
    weighed = written(_ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, table)), (F.col("rank") % len(table) + 1).cast("int"))), "weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, before = 0.0, -1.0
    while level > before:
        before = level
        above = F.lit(level) * F.col("weight") >= F.col("source_size") * most
        row = weighed.agg(
            F.sum(F.when(above, F.col("source_size") * most).otherwise(0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        level = (total - row["full"]) / row["free"] if row["free"] else before
    target = F.least(F.lit(level) * F.col("weight"), F.col("source_size") * float(most))
    return weighed.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _mix64(x):
    """A bijection of 64-bit words (numpy arrays), from the murmur3 finaliser."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(numbers, n: int, key: int, inverse: bool = False):
    """A keyed pseudorandom permutation of range(n): a four-round Feistel network on the
    smallest even number of bits that hold n, walked on until the value is below n."""
    import numpy as np

    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64)) for r in range(4)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ (_mix64(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (_mix64(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    x = once(np.asarray(numbers, dtype=np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _key(source: str | None, one_pass: int, seed: int) -> int:
    import hashlib

    said = f"{seed}:{one_pass}:" + ("0" if source is None else "1" + source)
    return int.from_bytes(hashlib.sha256(said.encode("utf-8", "surrogatepass")).digest()[:8], "little")


def slots_of(size: int, target: float, block: int, source, seed: int) -> tuple[int, int]:
    """How many slots a source fills, and the words that its last slot takes."""
    goal = round(target)
    if goal <= 0 or size <= 0:
        return 0, 0
    n = -(-size // block)
    done, rest = divmod(goal, size)
    if not rest:
        return done * n, block  # a cut beyond a short block's end changes nothing
    tail = size - (n - 1) * block
    at = int(permute([n - 1], n, _key(source, done, seed), inverse=True)[0])  # slot of the last, short block
    k = -(-rest // block)
    if at >= k:
        return done * n + k, rest - (k - 1) * block
    if rest <= at * block + tail:
        return done * n + at + 1, rest - at * block
    k = -(-(rest - tail) // block) + 1
    return done * n + k, rest - tail - (k - 2) * block


def _slot_counts(block: int, seed: int):
    def run(frames: Iterator):
        for f in frames:
            names = [None if x is None or x != x else x for x in f["source"]]
            both = [slots_of(int(n), float(t), block, s, seed) for s, n, t in zip(names, f["source_size"], f["target"], strict=True)]
            f["slots"], f["last"] = [k for k, _ in both], [w for _, w in both]
            yield f[["source", "source_size", "slots", "last"]].rename(columns={"source_size": "size"})

    return run


def draw(rng, left, n: int):
    """How many of n slots each source gets, of those it has left: multinomial by what is left, without replacement.
    Beyond the library's limit the plain multinomial draw, cut to what is left, and the rest to those with most left."""
    import numpy as np

    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    drawn = np.minimum(rng.multinomial(n, left / left.sum()), left)
    order = np.argsort(drawn - left, kind="stable")
    room = (left - drawn)[order]
    before = np.cumsum(room) - room
    drawn[order] += np.clip(n - drawn.sum() - before, 0, room)
    return drawn


def _split(width: int, shard_blocks: int, total: int, seed: int):
    """A range of shards cut into ranges of width, and each source's slots in it dealt to them."""

    def run(frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values("source", na_position="last", kind="stable", ignore_index=True)
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        rng = np.random.default_rng(_key(f"{low}-{high}", -1, seed))
        left, first, out = frame["count"].to_numpy(np.int64, copy=True), frame["first"].to_numpy(np.int64, copy=True), []
        for begin in range(low, high, width):
            end = min(begin + width, high)
            drawn = draw(rng, left, min(total, end * shard_blocks) - begin * shard_blocks)
            (used,) = np.nonzero(drawn)
            part = frame.iloc[used].copy()
            part["low"], part["high"], part["first"], part["count"] = begin, end, first[used], drawn[used]
            out.append(part)
            left, first = left - drawn, first + drawn
        return pd.concat(out)

    return run


RUN = "source string, size long, slots long, last long, low long, high long, first long, count long"


def draws(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """What each output shard mixes: source, size, slots, last, shard, first, count (the source's slots first to
    first + count - 1). A shard holds shard_blocks slots, the last one what is left.

    Shards draw the sources of their slots multinomially, by the sources' shares, given that the draws add up to
    what each source fills; that is a draw without replacement. It is made down a tree: a range of shards draws for
    its FAN parts, each of these for its own in another task, with a generator that the range seeds. A task holds a
    row for each source of a range."""
    counts = written(sources.mapInPandas(_slot_counts(block, seed), "source string, size long, slots long, last long").where("slots > 0"), "slots")
    total = counts.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = -(-total // shard_blocks)
    runs = counts.select("*", F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.lit(0).cast("long").alias("first"), F.col("slots").alias("count"))
    width = 1
    while width < shards:
        width *= FAN
    while width > 1:
        width //= FAN
        runs = runs.groupBy("low").applyInPandas(_split(width, shard_blocks, total, seed), RUN)
    return runs.select("source", "size", "slots", "last", F.col("low").alias("shard"), "first", "count")


def _slots(block: int, seed: int):
    """The block that each slot takes, and how many of its words."""

    def run(frames: Iterator):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                source = None if r.source is None or r.source != r.source else r.source
                n = -(-r.size // block)
                for begin in range(r.first, r.first + r.count, 65536):
                    j = np.arange(begin, min(begin + 65536, r.first + r.count), dtype=np.int64)
                    number = np.empty_like(j)
                    for one_pass in np.unique(j // n):
                        here = j // n == one_pass
                        number[here] = permute(j[here] % n, n, _key(source, int(one_pass), seed))
                    takes = np.where(j == r.slots - 1, r.last, block)
                    yield pd.DataFrame(
                        {
                            "source": pd.Series([source] * len(j), dtype=object),
                            "shard": np.full(len(j), r.shard, dtype=np.int64),
                            "slot": j,
                            "pass": j // n,
                            "number": number,
                            "takes": takes.astype(np.int64),
                        }
                    )

    return run


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash that orders the documents of a source."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        _doc_hash().alias("h"),
    )


def placed(table: DataFrame) -> DataFrame:
    """table (as `sized` gives it, written) with start, the words before a document in its source.

    Prefix sums in two levels: within (source, bucket) and over the buckets of a
    source, each about the square root of the source's size, so that a source with
    a third of all rows is no one task's work.
    """
    n = table.count()
    buckets = max(1, n // max(256, math.isqrt(n)))
    cut = table.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    sums = cut.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    over = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base")
    )
    inside = (
        W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    )
    local = cut.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    met = local.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    return met.select("doc_id", "source", "size", "h", (F.col("base") + F.col("local")).alias("start"))


def plan(table: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, **how):
    """The sources with their targets, and all slots: source, shard, slot, pass, number, takes."""
    sources = written(targets(table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), **how), "targets")
    runs = draws(sources, block, shard_blocks, seed)
    # Runs are few bytes but many slots: without a number they would be merged into a few tasks.
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = runs.repartition(parts, "source", "shard").mapInPandas(
        _slots(block, seed), "source string, shard long, slot long, pass long, number long, takes long"
    )
    return sources, slots


def pieces(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, **how):
    """(sources, sized table, mixture). The mixture has a row for each run of a document's words in a
    slot: source, shard, slot, pass, number, doc_id, h, start (of the document in its source), size,
    word (first one taken), n_words. `with_text` adds the words themselves."""
    table = written(sized(docs), "sized")
    sources, slots = plan(table, block, shard_blocks, seed, **how)
    laid = placed(table).where("size > 0")
    cut = laid.select(
        "*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("in_block")
    ).withColumnRenamed("source", "of")
    # The slots' number isn't known to the planner, which would take them for a few rows and broadcast them.
    met = slots.hint("merge").join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("number") == F.col("in_block")))
    begin = F.greatest(F.col("start"), F.col("number") * block)
    end = F.least(F.col("start") + F.col("size"), F.col("number") * block + F.col("takes"))
    mixture = met.select(
        "source", "shard", "slot", "pass", "number", "doc_id", "h", "start", "size",
        (begin - F.col("start")).alias("word"), (end - begin).alias("n_words"),
    ).where("n_words > 0")
    return sources, table, mixture


def _doc_hash():
    return F.xxhash64("doc_id", "text", "source")


def with_text(mixture: DataFrame, docs: DataFrame) -> DataFrame:
    """The mixture with text: the words of each run, joined by single spaces."""
    full = docs.select(F.col("doc_id").cast("long").alias("key"), _doc_hash().alias("own"), F.col("text").cast("string").alias("said")).distinct()
    met = mixture.join(full, (F.col("h") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("key")))
    taken = F.array_join(F.slice(words(F.col("said")), (F.col("word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    return met.select(*mixture.columns, taken.alias("text"))


def _key_of(source):
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    sources, table, mixture = pieces(docs, **how)
    got = mixture.groupBy("source", "start").agg(F.sum("n_words").alias("taken"))
    got = got.select(F.col("source").alias("s"), F.col("start").alias("at"), "taken")
    # Empty documents meet nothing; the hash spreads them, however many share a place.
    at = F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod(F.col("h"), F.lit(4096)))
    rows = placed(table).withColumn("key", at).withColumn("of", _key_of(F.col("source")))
    met = rows.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("at")), "left").select(
        "doc_id", "size", "source", "of", "h", F.coalesce("taken", F.lit(0)).alias("taken")
    )
    known = sources.select(_key_of(F.col("source")).alias("of"), "source_size", "target", "n_docs")
    out = attach(met, known, "of", "n_docs", table.count(), F.col("h"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mixture as documents: for each pass over a source, each document with the words that the pass takes of
    it, so that a document that two passes take comes twice. One taken whole keeps its text; of others, the words
    are joined by single spaces. The order of shards and slots is that of `pieces`; here rows have none. Columns are
    those of docs, whatever their names; n_chars, if there, is that of the new text. Of rows that agree in doc_id,
    text and source the one with the least JSON gives the other columns."""
    _, table, mixture = pieces(docs, **how)
    runs = mixture.groupBy("source", "start", "h", "doc_id", "size", "pass").agg(
        F.sum("n_words").alias("n"), F.array_sort(F.collect_list(F.struct("word", "n_words"))).alias("runs")
    ).select("h", F.col("doc_id").alias("id"), "size", "n", "runs")
    full = docs.select(_doc_hash().alias("own"), F.col("doc_id").cast("long").alias("key"), whole(docs).alias("row"))
    if not table.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        full = full.groupBy("key", "own").agg(F.min_by("row", F.to_json("row")).alias("row"))
    met = runs.join(full, (F.col("h") == F.col("own")) & F.col("id").eqNullSafe(F.col("key")))
    part, text = F.col("n") < F.col("size"), F.col("row")["text"].cast("string")
    met = met.withColumn("w", F.when(part, words(text)))
    each = F.transform("runs", lambda r: F.array_join(F.slice(F.col("w"), (r["word"] + 1).cast("int"), r["n_words"].cast("int")), " "))
    met = met.withColumn("new", F.when(part, F.array_join(each, " ")).otherwise(text))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return met.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
