"""Best-fit packing of token sequences with large-item matching.

Documents become token ids, each ended by an end id; only longer ones than a
sequence are cut. Lengths are whole numbers up to the capacity, so the packing is
planned on their histogram (at most `capacity` counters, however many documents):
pieces above a third of the capacity pair at most twice per bin, the longest first
with the longest that still fits; the smaller ones then go, the longest first, into
the bins with the smallest gap that holds them. The plan is a list of runs: so many
pieces of one length fill so many bins from this offset. A piece's rank among those of
its length, counted in two levels, finds its bin by binary search.

Defined cases: a null text is empty (one token, the end id); repeated rows and equal
doc_ids are packed as separate documents; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repograph.llm.common import bounded, slices, written

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
#: The vocabulary's one special token, which its tokenizer finds in texts.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids as the tokenizer file gives them. Ordinary text goes through the same vocabulary as
    ranks, which is several times faster; the rest, and what that refuses, through the file."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the regular expression gives up on very long runs by a panic
                if type(e).__name__ != "PanicException":  # the library's own; it can't be imported
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, of which only the first may be shorter."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1), strict=True))


def _tokenise(capacity: int, with_ids: bool):
    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, seen = Encoder(), [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in slices(batches):
            rows, ids_of = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    rows.append((doc_id, k, start, length, zlib.crc32(data), part, seen[length]))
                    ids_of.append(data)
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            if with_ids:
                arrays.append(pa.array(ids_of, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset), and the number of bins."""
    left = {n: c for n, c in histogram.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a length is outside 1..capacity")
    runs: list[tuple] = []
    used: dict[int, int] = {}
    gaps: dict[int, list[list[int]]] = {}  # gap: [first bin, bins]
    bins = 0

    def put(n: int, pieces: int, first_bin: int, each: int, offset: int) -> None:
        runs.append((n, used.get(n, 0), pieces, first_bin, each, offset))
        used[n] = used.get(n, 0) + pieces
        left[n] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        m = large[at] if at >= 0 else 0
        if not m:
            k = left[n]
            put(n, k, bins, 1, 0)
        elif m == n:
            k = left[n] // 2
            if k:
                put(n, 2 * k, bins, 2, 0)
                gaps.setdefault(capacity - 2 * n, []).append([bins, k])
                bins += k
            large.pop()
            if left[n]:  # one is left over; it pairs with the longest shorter one, if any
                m = large[-1] if large else 0
                put(n, 1, bins, 1, 0)
                if m:
                    put(m, 1, bins, 1, n)
                    if not left[m]:
                        large.pop()
                gaps.setdefault(capacity - n - m, []).append([bins, 1])
                bins += 1
            continue
        else:
            k = min(left[n], left[m])
            put(n, k, bins, 1, 0)
            put(m, k, bins, 1, n)
        gaps.setdefault(capacity - n - m, []).append([bins, k])
        bins += k
        large = [x for x in large if left[x]]
    order = sorted(g for g in gaps if g)
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                k = max(1, left[n] // each)
                gaps.setdefault(capacity, []).append([bins, k])
                bins += k
                order.append(capacity)
                continue
            gap = order[at]
            first, k = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            each = gap // n
            full = min(k, left[n] // each)
            if full:
                put(n, full * each, first, each, capacity - gap)
                rest = gap - each * n
                if rest:
                    _open(gaps, order, rest, [first, full])
            if k > full and left[n] and left[n] < each:  # the last pieces of this length share one bin
                some = left[n]
                put(n, some, first + full, some, capacity - gap)
                _open(gaps, order, gap - some * n, [first + full, 1])
                full += 1
            if k > full:
                _open(gaps, order, gap, [first + full, k - full])
    return runs, bins


def _open(gaps: dict, order: list, gap: int, group: list) -> None:
    if not gap:
        return
    if not gaps.get(gap):
        bisect.insort(order, gap)
        gaps[gap] = []
    gaps[gap].append(group)


def _assign(runs: list[tuple]):
    """runs is bounded by the lengths: a few for each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
        shift = np.int64(1) << 48  # (length, rank) as one number
        keys = table[:, 0] * shift + table[:, 1]
        for b in batches:
            d = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            length, rank = d["length"].to_numpy(), d["rank"].to_numpy()
            row = table[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 3] + k // row[:, 4], row[:, 5] + k % row[:, 4] * length
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([d[n] for n in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as
    little-endian 32-bit numbers)."""
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    more = ", ids binary" * with_ids
    pieces = written(rows.mapInArrow(_tokenise(capacity, with_ids), f"{schema}, part int, seq long{more}"), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(histogram, capacity)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # The table of bases grows with the tasks: no broadcast, whatever its file's size says.
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("base") + F.col("seq")).alias("rank")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return ranked.mapInArrow(_assign(runs), f"{schema}{more}, sequence_id long, offset long").select(*names)
