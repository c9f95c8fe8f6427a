"""Language identification with string kernels.

A text is the set of its letter n-grams of lengths 1 to 4 (lower case, words
bounded by a space): the blended-spectrum presence kernel counts the n-grams that
two texts share, over the n-grams known from the landmarks, scaled to 1 for equal
sets. Nyström landmarks are drawn from a bounded sample of labelled texts; kernel
ridge regression gives one score per language (one against the rest). The kernel
block of a batch is a product of presence matrices, and the scores its product
with the coefficients; as products associate, both landmark factors are multiplied
once, when the model is fitted.

Defined cases: a null text or one without a letter is `und` with score 0; without
labelled rows everything is `und`; a null doc_id counts as not held out and is not
learned from; repeated rows give repeated results; other columns are ignored by
`predict` and pass through `keep_known`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from repograph.llm.common import bounded, enough, share_of, slices, whole

#: The bounds of the fit: labelled rows per language and in all (one for each language at least), landmarks
#: (likewise), known n-grams, and the rows of one matrix.
ROWS_PER_LANGUAGE = 250
MOST_ROWS = 4000
LANDMARKS = 300
GRAMS = 16384
LENGTHS = (1, 2, 3, 4)
ROWS_AT_ONCE = 512
RIDGE = 1e-2
#: Steepness of the score in the margin between the best language and the next. Scores are rounded, as sums of
#: single precision differ a little with the batch that a text is in.
SLOPE = 6.0
UNKNOWN = "und"
TABLE_BITS = 20


@dataclass
class Model:
    languages: list
    keys: object  # 64-bit codes of the known n-grams, sorted
    weights: object  # n-grams x languages


def codes(text: str):
    """For each n-gram length the 64-bit codes of text's n-grams, with repeats (numpy)."""
    import numpy as np

    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _codes(x)


def _codes(x):
    """x: code points. Runs of others than letters become one separator. Each length's codes come from the
    last one's by one product and sum; a tag for the length and a final product spread them."""
    import numpy as np

    y = _letters()[x]
    other = y == 32
    keep = np.ones(len(y), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    y = y[keep].astype(np.uint64)
    out, c = [], None
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            if len(y) < n:
                continue
            c = y + np.uint64(1) if c is None else c[:-1] * np.uint64(0x100000001B3) + y[n - 1 :]
            out.append((c + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15))
    return out


_LETTERS = None


def _letters():
    """Code point -> itself if a letter, else a space; built once in each process."""
    global _LETTERS
    if _LETTERS is None:
        import numpy as np

        _LETTERS = np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32)
    return _LETTERS


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """rows: (text, language), a bounded sample. The matrices are made for ROWS_AT_ONCE rows at a time; whole are
    only those of landmarks by n-grams and of landmarks by languages."""
    import numpy as np

    rows = [(t, la) for t, la in rows if t and has_letter(t)]
    if not rows:
        return None
    languages = sorted({la for _, la in rows})
    number = {la: k for k, la in enumerate(languages)}
    sets = [np.unique(np.concatenate(codes(t))) for t, _ in rows]
    # landmarks: in turn from each language, in the sample's (hash) order
    by: dict = {la: [] for la in languages}
    for i, (_, la) in enumerate(rows):
        by[la].append(i)
    most, depth = min(max(LANDMARKS, len(languages)), len(rows)), 0
    marks: list[int] = []
    while len(marks) < most:
        marks += [by[la][depth] for la in languages if depth < len(by[la])]
        depth += 1
    marks = marks[:most]
    grams, count = np.unique(np.concatenate([sets[i] for i in marks]), return_counts=True)
    if len(grams) > GRAMS:
        grams = np.sort(grams[np.lexsort((grams, -count))[:GRAMS]])

    def unit(which):
        """Presence rows scaled to length 1."""
        out = np.zeros((len(which), len(grams)), dtype=np.float32)
        for k, i in enumerate(which):
            at = np.minimum(np.searchsorted(grams, sets[i]), len(grams) - 1)
            out[k, at[grams[at] == sets[i]]] = 1
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    landmark = unit(marks)
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    left, right = RIDGE * len(rows) * np.eye(root.shape[1]) / 100, np.zeros((root.shape[1], len(languages)))
    share = np.array([len(rows) / len(by[la]) / len(languages) for la in languages])  # languages count alike
    for begin in range(0, len(rows), ROWS_AT_ONCE):
        part = range(begin, min(begin + ROWS_AT_ONCE, len(rows)))
        features = (unit(part) @ landmark.T).astype(np.float64) @ root
        own = np.array([number[rows[i][1]] for i in part])
        weighed = features * share[own][:, None]
        left += features.T @ weighed
        right -= weighed.sum(0)[:, None]  # truth is 1 for the own language, -1 for the others
        np.add.at(right.T, own, 2 * weighed)
    alpha = root @ np.linalg.solve(left, right)
    return Model(languages, grams, (landmark.T.astype(np.float64) @ alpha).astype(np.float32))


class Scorer:
    """Presence matrices of batches, times the model."""

    def __init__(self, model: Model) -> None:
        import numpy as np

        self.model = model
        # A cell for each value of a code's leading bits: the known n-gram in it, -1 if none, -2 if several.
        self.bits = np.uint64(64 - TABLE_BITS)
        cells = (model.keys >> self.bits).astype(np.int64)
        self.cell = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        self.cell[cells] = np.arange(len(cells))
        self.cell[cells[1:][cells[1:] == cells[:-1]]] = -2

    def presence(self, texts: list[str]):
        import numpy as np

        keys = self.model.keys
        out = np.zeros((len(texts), len(keys)), dtype=np.float32)
        for i, t in enumerate(texts):
            for begin in range(0, max(1, len(t)), 1 << 18):  # long texts in parts that overlap by the longest n-gram
                for c in codes(t[begin : begin + (1 << 18) + max(LENGTHS)]):
                    at = self.cell[(c >> self.bits).astype(np.int64)]
                    one = at >= 0
                    found = at[one]
                    out[i, found[keys[found] == c[one]]] = 1
                    several = c[at == -2]
                    if len(several):
                        found = np.minimum(np.searchsorted(keys, several), len(keys) - 1)
                        out[i, found[keys[found] == several]] = 1
        return out

    def __call__(self, texts: list[str]):
        """Languages' scores, one row per text."""
        import numpy as np

        p = self.presence(texts)
        return (p @ self.model.weights) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))


def _predict(broadcast, inside: bool):
    """Adds lang_pred and score to all columns but a first one, text; with inside the text is in a first one, row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        model = broadcast.value
        scorer = Scorer(model) if model is not None else None
        for b in slices(batches):
            texts = (pc.struct_field(b.column(0), "text") if inside else b.column(0)).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            able = [i for i, t in enumerate(texts) if t and has_letter(t)] if scorer else []
            for begin in range(0, len(able), 64):
                part = able[begin : begin + 64]
                raw = scorer([texts[i] for i in part])
                best = raw.argmax(1)
                top = np.sort(raw, axis=1)
                margin = top[:, -1] - (top[:, -2] if raw.shape[1] > 1 else -1.0)
                for i, k, m in zip(part, best, margin, strict=True):
                    langs[i], scores[i] = model.languages[k], round(float(1 / (1 + np.exp(-SLOPE * float(m)))), 4)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(not inside, b.num_columns)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names[not inside :], "lang_pred", "score"],
            )

    return run


def held_out():
    """crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The labelled rows to learn from: per language those with the least hash of doc_id and text, none held out.

    Rows that repeat doc_id and text count once. What reaches the driver is at most MOST_ROWS whole texts, or one
    for each language if there are more languages."""
    h = F.xxhash64(F.col("doc_id").cast("string"), "text")
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("la"), F.col("text").cast("string").alias("said"), h.alias("own")
    )
    counts = {r["la"]: r["n"] for r in able.groupBy("la").agg(F.count("*").alias("n")).collect()}
    each = max(1, min(ROWS_PER_LANGUAGE, MOST_ROWS // max(1, len(counts))))
    chosen: dict = {}
    for share in (lambda n: enough(each, n), lambda n: 1.0):  # the second for languages of which no hash is that small
        left = {la: share(n) for la, n in counts.items() if la not in chosen}
        if not left:
            break
        most = F.create_map(*(F.lit(x) for pair in left.items() for x in pair))
        keys = able.where(share_of(F.col("own")) <= F.coalesce(most[F.col("la")], F.lit(-1.0))).select("la", "own").distinct()
        top = keys.withColumn("r", F.row_number().over(W.partitionBy("la").orderBy("own"))).where(F.col("r") <= each)
        for r in top.collect():
            chosen.setdefault(r["la"], []).append(r["own"])
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(la, h) for la, hs in chosen.items() for h in hs], "la string, own long")
    got = able.join(F.broadcast(wanted), ["la", "own"], "left_semi").dropDuplicates(["la", "own"]).collect()
    return [(r["said"], r["la"]) for r in sorted(got, key=lambda r: (r["own"], r["la"]))]


def _scored(docs: DataFrame, rows: DataFrame, inside: bool) -> DataFrame:
    """rows, of docs, with lang_pred and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs)))  # GRAMS rows, a column for each language
    schema = StructType([*rows.schema.fields[not inside :], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return bounded(rows).mapInArrow(_predict(model, inside), schema)


def predict(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    return _scored(docs, docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")), False)


def keep_known(docs: DataFrame, fill: str = "lang") -> DataFrame:
    """The rows of docs with a known language, with all their columns, whatever their names; where the column
    fill is null it gets the prediction."""
    kept = _scored(docs, docs.select(whole(docs).alias("row")), True).where(F.col("lang_pred") != UNKNOWN)
    new = {fill: F.coalesce(F.col("row")[fill], "lang_pred")} if fill in docs.columns else {}
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
