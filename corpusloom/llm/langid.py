"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, characters other than letters become single-width gaps, and n-grams of one to three characters
are hashed into DIMS features. A feature's weight in a text is its share of the text's n-grams times its inverse
document frequency. Document frequencies cover every training document; the weights are trained by
follow-the-regularised-leader with L1 and L2 penalties on at most TRAIN_ROWS documents (the bound of the sample),
chosen by a hash of the id; a temperature is then fitted on every fifth of them, which training leaves out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusloom.llm.common import carried
from corpusloom.llm.quality import held_out

DIMS, NGRAMS = 1 << 15, 3
TRAIN_ROWS, EPOCHS, SEED = 4000, 3, 5
#: Step size, its smoothing, and the penalties of the learner; SCALE brings shares to about 1.
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.02, 0.02, 30.0
#: Characters handled at a time.
SPAN = 1 << 18
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(text: str) -> tuple[np.ndarray, bool]:
    """(lower-cased code points with gaps for all but letters and one at each end, whether there is a letter)."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[raw]
    return np.where(letter, raw, np.uint32(32)), bool(letter.any())


def features(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of all lengths; every call gives a part of at most about SPAN places."""
    for at in range(0, len(points), SPAN):
        h = np.zeros(0, np.uint32)
        part = points[at : at + SPAN + NGRAMS - 1]
        for n in range(1, NGRAMS + 1):
            own = part[n - 1 :]
            h = (own if n == 1 else (h[: len(own)] ^ (own * np.uint32(0x9E3779B1)))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            h = h ^ (h >> np.uint32(15))
            yield (h[: SPAN if at + SPAN < len(points) else len(h)] & np.uint32(DIMS - 1)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # DIMS x languages: weights times inverse document frequencies
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; UNKNOWN and 0 without a letter or a learned language."""
        points, any_letter = code_points(text or "")
        if not any_letter or not self.langs:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.langs)), 0
        for f in features(points):
            total += self.table[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        p = softmax((total * (SCALE / n) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def learn(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """A model from rows (language, feature numbers, their shares), in a fixed order."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0), 1.0)
    c, no = len(langs), {x: i for i, x in enumerate(langs)}
    kept_back = [i for i in range(len(rows)) if i % 5 == 4]
    taught = [i for i in range(len(rows)) if i % 5 != 4]
    z, n = np.zeros((DIMS + 1, c)), np.zeros((DIMS + 1, c))  # the last feature is the constant

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        return np.where(np.abs(zf) <= L1, 0.0, w)

    sparse = [(np.append(f, DIMS), np.append(SCALE * share * idf[f], 1.0), no[lang]) for lang, f, share in rows]
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in rng.permutation(taught):
            f, x, y = sparse[i]
            w = weights(f)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g[None, :]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(DIMS + 1))
    held = [(sparse[i][1] @ w[sparse[i][0]], sparse[i][2]) for i in (kept_back or range(len(rows)))]
    grid = np.exp(np.linspace(np.log(0.2), np.log(8), 60))
    losses = [-sum(np.log(max(softmax(s / t)[y], 1e-12)) for s, y in held) for t in grid]
    return Model(langs, (w[:DIMS] * idf[:, None]).astype(np.float32), w[DIMS], float(grid[int(np.argmin(losses))]))


def _document_frequency(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for b in it:
        for text in b.column(0):
            seen = np.zeros(DIMS, bool)
            for f in features(code_points(text.as_py() or "")[0]):
                seen[f] = True
            df += seen
            n += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, DIMS)), pa.array(np.append(df[used], n))], ["feature", "df"]
    )


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for text in b.column(2):
            count = np.zeros(DIMS, np.int64)
            for f in features(code_points(text.as_py() or "")[0]):
                count += np.bincount(f, minlength=DIMS)
            used = np.flatnonzero(count)
            out.append((used, count[used] / max(1, count.sum())))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.list_(pa.float64()))],
            ["id", "lang", "features", "shares"],
        )


def train(docs: DataFrame, taught: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model from the documents for which `taught` holds and whose language is not null. Document frequencies come from
    all of them, weights from at most `rows`; of rows with one id, all are in that sample or none. Rows without an id
    only count in the frequencies."""
    known = docs.filter(taught & F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{text}`").alias("_text")
    )
    counted = (
        known.select("_text").mapInArrow(_document_frequency, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    )  # DIMS + 1 rows at most
    df, total = np.zeros(DIMS), 0
    for f, k in zip(counted.column("feature").to_pylist(), counted.column("df").to_pylist(), strict=True):
        if f == DIMS:
            total = k
        else:
            df[f] = k
    idf = np.log((1 + total) / (1 + df))
    chosen = known.filter("_id is not null").select("_id").orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(rows)
    sample = (
        known.join(F.broadcast(chosen.distinct()), "_id", "left_semi")  # bounded by the limit
        .select(F.col("_id").cast("string").alias("id"), "_lang", "_text")
        .mapInArrow(_rows, "id string, lang string, features array<long>, shares array<double>")
        .toArrow()
    )
    found = [
        (i, x, f.values.to_numpy(), s.values.to_numpy())
        for i, x, f, s in zip(sample["id"].to_pylist(), sample["lang"].to_pylist(), sample["features"], sample["shares"], strict=True)
    ]
    found.sort(key=lambda r: (r[0], r[1], len(r[2])))
    order = np.random.default_rng(SEED).permutation(len(found))
    return learn([found[i][1:] for i in order], idf)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with _lang_pred and _lang_score, the calibrated probability of the prediction.

    A text that is null, empty or without a letter is `und` with score 0, and so is every text if nothing was learned.
    Every row gives one row, repeated ones too; other columns pass through, whatever their names; one named like an output
    is replaced by it. An empty table gives an empty table."""
    names = [c for c in docs.columns if c.lower() not in ("_lang_pred", "_lang_score")]
    held, at = docs.select(carried(docs, "_lang_pred", "_lang_score")), names.index(text)
    schema = StructType([held.schema["row"], StructField("pred", StringType()), StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [sent.value.predict(t.as_py()) for t in b.column(0).field(at)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["row", "pred", "score"]
            )

    out = held.mapInArrow(apply, schema)
    return out.select(*[F.col(f"row.`{c}`") for c in names], F.col("pred").alias("_lang_pred"), F.col("score").alias("_lang_score"))


def taught_by_id(doc_id: str = "doc_id") -> Column:
    return ~held_out(doc_id, 3, 1)
