"""Language ID (operator 2): nearest centroid with rejection.

A text becomes a vector of character n-grams (two and three UTF-8 bytes, A-Z in
lower case, every run of other ASCII signs one space) hashed to ``DIMS`` classes, weighted by TF-IDF
(1 + log(count) times log((1 + n) / (1 + df)) + 1) and normalised to length 1.
Every language has up to ``CLUSTERS`` centroids (spherical k-means).  A text
gets the language of the centroid with the largest cosine; ``score`` is that
cosine, and ``rejected`` says that it lies below the least cosine that the
centroid's own members reach (their ``REJECT`` quantile): too far from
everything learned to be trusted.

Learning.  Only training rows are used: text and language, never doc_id or
source.  Document frequencies are counted over all training rows.  The
clusters are fitted on a hash sample of each language's distinct texts
(``sampled``: those with the least hashes, ``SAMPLE`` at most, all if there are
fewer; copies count once), one language per task; the model (languages x clusters x DIMS numbers) is what reaches the
driver and the tasks.

Prediction reads whole texts.  Null texts and texts without a letter are
"und" with score 0; so is everything when there are no training rows.  Ties go
to the first language in alphabetical order.  Repeated rows are predicted
alike; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanscope.llm.tables import read_table
from loanscope.llm.textbatch import LOWER, mix64, slices, text_buffers

DIMS = 4096
CLUSTERS = 4
SAMPLE = 300
REJECT = 0.005
ROWS = 512  # texts per step of a task: 8 MB of counts
# A-Z in lower case, other ASCII signs as spaces
_LETTERS = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 0x20).astype(np.uint8)


def has_letter(text: str) -> bool:
    """Whether a character of a text is a letter (general category L)."""
    return any(map(str.isalpha, text))


_TABLES: dict = {}


def _classes(n: int, dims: int) -> np.ndarray:
    """Class of every n-byte code (32 MB for three bytes, built in steps)."""
    if (n, dims) not in _TABLES:
        table = np.empty(1 << (8 * n), np.int16)
        for lo in range(0, len(table), 1 << 18):
            codes = np.arange(lo, min(len(table), lo + (1 << 18)), dtype=np.uint64)
            table[lo:lo + (1 << 18)] = mix64(codes + np.uint64(n << 40)) % np.uint64(dims)
        _TABLES[n, dims] = table
    return _TABLES[n, dims]


def gram_counts(data: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(texts x dims) counts of hashed byte bigrams and trigrams."""
    n_docs = len(offs) - 1
    low = _LETTERS[data].astype(np.uint32)
    gap = (low[1:] == 0x20) & (low[:-1] == 0x20)
    out = np.zeros(n_docs * dims, np.int32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offs))
    for n in (2, 3):
        m = len(low) - n + 1
        if m <= 0:
            continue
        code = low[:m].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | low[k:k + m]
        inside = (doc[:m] == doc[n - 1:]) & ~gap[:m]
        if n == 3:
            inside &= ~gap[1:m + 1]
        cell = doc[:m] * np.int32(dims) + _classes(n, dims)[code]
        out += np.bincount(cell[inside], minlength=len(out)).astype(np.int32)
    return out.reshape(n_docs, dims)


def parts(batches, text_col: str = "text"):
    """Slices of at most ``ROWS`` texts, which bounds the counts of a slice."""
    for b in slices(batches, text_col):
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def fit_clusters(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, assignment) of unit vectors: farthest-first start, then
    spherical k-means; empty clusters are left out."""
    centres = [int(np.argmax(v @ v.mean(0)))]
    best = v @ v[centres[0]]
    while len(centres) < min(k, len(v)):
        centres.append(int(np.argmin(best)))
        best = np.maximum(best, v @ v[centres[-1]])
    c = v[centres]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, 1)
        c = np.stack([v[own == i].mean(0) for i in np.unique(own)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32), np.argmax(v @ c.T, 1)


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, least: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.least, self.idf = langs, centroids, least, idf

    def predict(self, data: np.ndarray, offs: np.ndarray):
        """(index of the nearest centroid, cosine) of every text."""
        cos = tfidf(gram_counts(data, offs), self.idf) @ self.centroids.T
        best = np.argmax(cos, 1)
        return best, cos[np.arange(len(best)), best]


def sampled(train: DataFrame, sample: int) -> DataFrame:
    """(lang, text): of every language the distinct texts with the least
    hashes (low bits), ``sample`` at most."""
    rows = train.select("lang", "text", F.xxhash64("text").alias("h"))
    distinct = rows.select("lang", "h").distinct()
    sizes = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    # about twice as many as are taken, so that the ranking does not grow with the texts
    near = distinct.join(F.broadcast(sizes), "lang").filter(part * F.col("n") <= 2 * sample)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(part, "h"))
    least = near.withColumn("rank", rank).filter(F.col("rank") <= sample)
    # sample x languages rows
    return rows.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]) \
        .groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(train: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, reject: float = REJECT) -> Model | None:
    """The model of rows (text, lang); rows with a null are ignored."""
    train = train.select("text", "lang").dropna()

    def frequencies(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for b in parts(batches):
            df += (gram_counts(*text_buffers(b.column(0))) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, DIMS)), pa.array(np.append(n, df))], names=["dim", "n"])

    total = {r["dim"]: r["n"] for r in train.mapInArrow(frequencies, "dim bigint, n bigint")
             .groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    rows = total.get(-1, 0)
    if not rows:
        return None
    df = np.array([total[i] for i in range(DIMS)])
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)

    def cluster(table: pa.Table) -> pa.Table:
        v = tfidf(gram_counts(*text_buffers(table.column("text"))), idf)
        c, own = fit_clusters(v, clusters)
        cos = (v * c[own]).sum(1)
        used = np.unique(own)
        return pa.table({
            "lang": pa.array([table.column("lang")[0].as_py()] * len(used), pa.string()),
            "least": pa.array([float(np.quantile(cos[own == i], reject)) for i in used], pa.float64()),
            "centroid": pa.array([c[i].astype("<f4").tobytes() for i in used], pa.binary())})

    found = sampled(train, sample).groupBy("lang").applyInArrow(cluster, "lang string, least double, centroid binary").collect()
    found = sorted(found, key=lambda r: (r["lang"], r["centroid"]))
    if not found:
        return None
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["centroid"], "<f4") for r in found]),
                 np.array([r["least"] for r in found]), idf)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of rows (doc_id, text)."""
    def run(batches):
        for b in parts(batches):
            texts = b.column(1).to_pylist()
            known = [bool(t) and has_letter(t) and model is not None for t in texts]
            if model is not None:
                best, cos = model.predict(*text_buffers(b.column(1)))
            else:
                best, cos = np.zeros(len(texts), int), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()),
                 pa.array([model.langs[i] if k else "und" for i, k in zip(best, known)], pa.string()),
                 pa.array([float(min(1.0, max(0.0, c))) if k else 0.0 for c, k in zip(cos, known)], pa.float64()),
                 pa.array([not k or bool(c < model.least[i]) for i, c, k in zip(best, cos, known)], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def is_held_out(doc_id):
    """Whether a row is kept for testing (one with a null doc_id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~is_held_out(F.col("doc_id"))))
    return predict(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE = {}
