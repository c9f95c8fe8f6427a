"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS bits have a common variant within half of it of
both. Emitting that whole ball (2,081 variants of 64 bits) is the exact but large
form. It is needed only among crowded fingerprints; for all of them the same
construction runs on projections: of three blocks of the 64 bits one holds at least
two of any four differing bits, so on the other two blocks the pair differs in two
bits at most and meets in the ball of radius one there (132 variants in all). Colliding
pairs are verified on all 64 bits within a bucket, and only a spanning star of each
bucket's linked members goes on. The members of a bucket above CROWD, whose
verification would be quadratic, take the full ball instead, where any two that
collide are within RADIUS by the triangle inequality, so a star needs no check.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; equal texts share a fingerprint; a null doc_id is never a component's id while
another is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import attach, bounded, discard, slices, unused, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Bounds of the three blocks.
BLOCKS = ((0, 21), (21, 42), (42, 64))
CROWD = 2048
#: Shingles hashed at once.
AT_ONCE = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """64 bits, as an unsigned number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    view, sums = memoryview(joined), np.zeros(64, np.int64)
    for begin in range(0, n, AT_ONCE):
        part = range(begin, min(n, begin + AT_ONCE))
        h = np.fromiter((xxh64_intdigest(view[starts[i] : stops[i]], SEED) for i in part), np.uint64, len(part))
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    for b in slices(batches):
        found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _xored(fp, masks: list[int], keep: int):
    return F.transform(F.lit([_signed(m) for m in masks]), lambda m: fp.bitwiseAND(F.lit(_signed(keep))).bitwiseXOR(m))


def projected(fps: DataFrame) -> DataFrame:
    """key, fp: for each fingerprint the balls of radius one on its three projections."""
    balls = []
    for low, high in BLOCKS:
        keep = ((1 << 64) - 1) ^ ((1 << high) - (1 << low))
        tag = 1 << low  # keys of different projections rarely meet; if they do, verification tells
        balls.append(_xored(F.col("fp"), [tag] + [tag | 1 << b for b in range(64) if not low <= b < high], keep))
    return fps.select(F.explode(F.concat(*balls)).alias("key"), "fp")


def full_ball(fps: DataFrame, radius: int = RADIUS // 2) -> DataFrame:
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return fps.select(F.explode(_xored(F.col("fp"), masks, (1 << 64) - 1)).alias("key"), "fp")


def linked(members, radius: int = RADIUS):
    """(a, b) stars that join the members (signed, distinct) as links within the radius do."""
    import numpy as np

    x = members.view(np.uint64)
    if len(x) == 2:
        return members[1:], members[:1] if (int(x[0]) ^ int(x[1])).bit_count() <= radius else members[:0]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(x))
    return members[moved], members[label[moved]]


def _buckets(crowd: int, star: bool):
    """Of rows sorted by key: stars (a, b) of each bucket's linked members; of a bucket above
    crowd its members as (a, null). With star, all members of a bucket are linked and none is kept."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def give(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def close(fp):
            if len(fp) > crowd:
                return fp, None
            fp = np.unique(fp)
            if len(fp) < 2:
                return fp[:0], fp[:0]
            a, b = linked(fp)
            return (a, b) if len(b) else (a[:0], b)

        held_key, held = None, []  # the bucket that the last batch ended in
        over = False  # it is crowded, and what was held is sent
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(key):
                continue
            if star:
                first = np.concatenate([[True], key[1:] != key[:-1]])
                root = fp[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
                if held_key == key[0]:
                    root[: len(key) if first.sum() == 1 else np.nonzero(first)[0][1]] = held
                held_key, held = key[-1], root[-1]
                out = root != fp
                if out.any():
                    yield give(fp[out], root[out])
                continue
            cuts = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
            sizes, outs, crowded = np.diff(cuts), [], []
            last = len(sizes) - 1
            for i in sorted({0, last, *np.nonzero(sizes > 1)[0].tolist()}):
                part = fp[cuts[i] : cuts[i + 1]]
                if i == 0 and held_key is not None and held_key == key[0]:
                    held.append(part)
                else:
                    if held_key is not None:
                        if not over:
                            outs.append(close(np.concatenate(held)))
                        held_key = None
                    if i < last:
                        outs.append(close(part))
                        continue
                    held_key, held, over = key[-1], [part], False
                if sum(map(len, held)) > crowd or over:
                    crowded.append(np.concatenate(held))
                    held, over = [], True
                if i < last:  # the held bucket ends within this batch
                    if not over:
                        outs.append(close(np.concatenate(held)))
                    held_key, held, over = None, [], False
            pairs = [(a, b) for a, b in outs if b is not None and len(b)]
            if pairs:
                yield give(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
            for a in [a for a, b in outs if b is None] + crowded:
                yield give(a, [None] * len(a))
        if not star and held_key is not None and not over and held:
            a, b = close(np.concatenate(held))
            if len(a):
                yield give(a, b if b is not None else [None] * len(a))

    return run


def edges(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct (a, b) that connect distinct fingerprints just as their links within RADIUS do."""
    met = projected(fps).repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(crowd, False), "a long, b long")
    found = written(met.distinct(), "links")
    dense = found.where("b is null").select(F.col("a").alias("fp"))
    out = found.where("b is not null")
    if dense.isEmpty():
        return out
    stars = full_ball(dense).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_buckets(0, True), "a long, b long")
    return written(out.unionByName(stars).distinct(), "links")


def components(pairs: DataFrame) -> DataFrame:
    """v, root for the nodes of pairs (a, b): least label of neighbours, then of the label's label,
    until no neighbour has a lesser one. Each round's tables are written and the last ones deleted. A node
    with very many neighbours, and a label that very many nodes carry, are hot keys of `attach`."""
    both = written(
        pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("u"))), "arcs"
    )
    label = written(both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")).select("v", F.least("v", "m").alias("root"), "n"), "roots")
    arcs, nodes = both.count(), label.count()
    while True:
        near = attach(both, label.select(F.col("v").alias("u"), "root", "n"), "u", "n", arcs, F.xxhash64("v")).groupBy("v").agg(F.min("root").alias("m"))
        new = written(label.join(near, "v").select("v", "n", F.col("root").alias("old"), F.least("root", "m").alias("r")), "near")
        if new.where("r <> old").isEmpty():
            return label.select("v", "root")
        jump = label.select(F.col("v").alias("r"), F.col("root").alias("rr"))
        jump = written(new.groupBy("r").agg(F.count("*").alias("c")).join(jump, "r"), "jumps")
        far = attach(new, jump, "r", "c", nodes, F.xxhash64("v")).select("v", F.least("r", "rr").alias("root"), "n")
        last, label = label, written(far, "roots")
        discard(last, new, jump)


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, component_size."""
    marked = written(fingerprints(docs), "fingerprints")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    label = components(edges(fps.select("fp"), crowd))
    met = written(label.join(fps, label["v"] == fps["fp"]).select("v", "root", "low", "n"), "members")
    ids = written(met.groupBy("root").agg(F.min("low").alias("cid"), F.sum("n").alias("size"), F.count("*").alias("c")), "components")
    of = attach(met.select("v", "root"), ids, "root", "c", met.count(), F.xxhash64("v")).select("v", "cid", "size")
    known = written(
        fps.join(of, fps["fp"] == of["v"], "left").select(
            "fp", "n", F.coalesce("cid", "low").alias("component_id"), F.coalesce("size", "n").alias("component_size")
        ),
        "classes",
    )
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = attach(marked, known, "fp", "n", total, F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def keep_first(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of docs that stay, one document for each component, with all their columns.
    doc_id is taken as a document's key: rows that repeat one stay or go together."""
    found = near_duplicates(docs, crowd)
    (own,) = unused(docs.columns, "id")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own))
    return docs.join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
