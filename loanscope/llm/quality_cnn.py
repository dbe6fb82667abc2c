"""Quality classifier (operator 11): a byte-level convolutional network.

Every byte of a text enters as the eight signs of its bits.  ``FILTERS``
learned filters of ``WIDTH`` bytes run over all positions of the text; in each
chunk of ``CHUNK`` bytes (every chunk overlaps half of the next one, together
they cover the whole text) the largest response of a filter counts (max
pooling).  A layer of ``HIDDEN`` units reads each chunk, the mean and the
maximum of these units over all chunks go into one logistic unit: the
probability of label 1.  A chunk that says one thing over and over excites few
filters, so repetition shows as well as odd signs do.  Everything is numpy.

Learning.  Labelled rows only, text and label, never doc_id, lang or source.
Of either label the ``SAMPLE`` rows with the least hashes of their ids are
taken (all if there are fewer); of a sampled text longer than ``SEGMENT`` bytes
one segment of that length, at a place that its own hash draws, is learned
from.  That bounds the training set to 2 * SAMPLE * SEGMENT bytes (12 MB), which
one task holds.  Both labels weigh alike in training; afterwards the bias moves
by the log odds of the labels over all training rows, so that a score is a
probability for rows like those.  What leaves the training task is the model,
a few ten kilobytes.

Scoring reads whole texts, in steps of ``STEP`` positions: memory does not grow
with a text beyond its pooled responses.  Null and empty texts have one chunk
without any response and get the model's score for that.  Without a training
row of either label there is nothing to tell apart: the score is the share of
label 1 among training rows, 0.5 if there are none.  Null labels are ignored,
of repeated labels of a doc_id the smallest counts, labels of unknown documents
are dropped by the join; a null doc_id has no label and is scored like any
other row.  Repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.tables import read_table
from loanscope.llm.textbatch import slices, text_buffers

WIDTH = 7
FILTERS = 48
HIDDEN = 16
BLOCK = 64            # positions pooled first
CHUNK = 4 * BLOCK     # a chunk is four blocks and begins every two
SAMPLE = 1500
SEGMENT = 4096
EPOCHS = 12
BATCH = 32
RATE = 0.004
STEP = 1 << 14
SLICE = 1 << 19

_BITS = np.zeros((257, 8), np.float32)  # the last row pads
_BITS[:256] = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1
_PAD = 256


class Layout:
    """Texts laid out in whole blocks: ``code`` the bytes (padded), ``first``
    the first block of every text, ``idle`` the positions that start beyond
    their text; ``chunk`` the first block of every chunk, ``stop`` the end of
    its blocks, ``begin`` the first chunk of every text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        size = np.diff(offs)
        blocks = -(-(size + WIDTH - 1) // BLOCK)  # no window reaches into the next text
        self.first = np.concatenate(([0], np.cumsum(blocks)))
        self.code = np.full(self.first[-1] * BLOCK + WIDTH - 1, _PAD, np.int16)
        for lo, hi, at in zip(offs[:-1].tolist(), offs[1:].tolist(), (self.first[:-1] * BLOCK).tolist()):
            self.code[at:at + hi - lo] = data[lo:hi]
        spare = blocks * BLOCK - size  # at least WIDTH - 1
        skip = np.repeat(self.first[1:] * BLOCK - np.cumsum(spare), spare)
        self.idle = np.arange(spare.sum()) + skip
        chunks = np.maximum(1, -(-(blocks - 2) // 2))
        self.begin = np.concatenate(([0], np.cumsum(chunks)))
        own = np.repeat(np.arange(len(size)), chunks)
        self.chunk = self.first[own] + 2 * (np.arange(self.begin[-1]) - self.begin[own])
        self.stop = np.minimum(self.chunk + CHUNK // BLOCK, self.first[own + 1])


def windows(code: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The bits of the WIDTH bytes from every position lo..hi-1 on."""
    x = _BITS[code[lo:hi + WIDTH - 1]]
    step = x.strides[0]
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(x, (hi - lo, 8 * WIDTH), (step, 4)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Network:
    """Parameters and the forward pass."""

    SHAPES = {"k": (8 * WIDTH, FILTERS), "kb": (FILTERS,), "h": (FILTERS, HIDDEN), "hb": (HIDDEN,),
              "o": (2 * HIDDEN,), "ob": (1,)}

    def __init__(self, values: dict[str, np.ndarray]):
        self.p = values

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        p = {n: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) if len(s) == 2 else
             np.zeros(s, np.float32) for n, s in cls.SHAPES.items()}
        p["o"] = (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32)
        return cls(p)

    def to_bytes(self) -> bytes:
        return b"".join(self.p[n].astype("<f4").tobytes() for n in self.SHAPES)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        flat, at, p = np.frombuffer(raw, "<f4"), 0, {}
        for n, s in cls.SHAPES.items():
            size = int(np.prod(s))
            p[n] = flat[at:at + size].reshape(s).copy()
            at += size
        return cls(p)

    def responses(self, lay: Layout, where: bool = False):
        """The largest response of every filter in every block, and with
        ``where`` its position (blocks x filters)."""
        n = lay.first[-1] * BLOCK
        out = np.empty((lay.first[-1], FILTERS), np.float32)
        pos = np.empty(out.shape, np.int64) if where else None
        for lo in range(0, n, STEP):
            hi = min(n, lo + STEP)
            a = windows(lay.code, lo, hi) @ self.p["k"]
            i = np.searchsorted(lay.idle, (lo, hi))
            a[lay.idle[i[0]:i[1]] - lo] = -np.inf
            a = a.reshape(-1, BLOCK, FILTERS)
            b = slice(lo // BLOCK, hi // BLOCK)
            if where:
                pos[b] = a.argmax(1) + np.arange(lo, hi, BLOCK)[:, None]
            out[b] = a.max(1)
        return out, pos

    def heads(self, pooled: np.ndarray, lay: Layout):
        """Logits from the pooled responses of the chunks."""
        f = np.maximum(pooled + self.p["kb"], 0)
        h = np.maximum(f @ self.p["h"] + self.p["hb"], 0)
        n = np.diff(lay.begin)[:, None]
        mean = np.add.reduceat(h, lay.begin[:-1], axis=0) / n
        top = np.maximum.reduceat(h, lay.begin[:-1], axis=0)
        return f, h, mean, top, np.hstack((mean, top)) @ self.p["o"] + self.p["ob"]

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every text of a batch."""
        if len(offs) < 2:
            return np.zeros(0)
        lay = Layout(data, offs)
        blocks, _ = self.responses(lay)
        pooled = blocks[lay.chunk]
        for k in range(1, CHUNK // BLOCK):
            pooled = np.maximum(pooled, blocks[np.minimum(lay.chunk + k, lay.stop - 1)])
        return sigmoid(self.heads(pooled, lay)[-1].astype(np.float64))

    def gradients(self, data: np.ndarray, offs: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over a batch."""
        lay = Layout(data, offs)
        blocks, pos = self.responses(lay, where=True)
        pooled, at = blocks[lay.chunk], pos[lay.chunk]
        for k in range(1, CHUNK // BLOCK):
            other = np.minimum(lay.chunk + k, lay.stop - 1)
            more = blocks[other] > pooled
            pooled = np.where(more, blocks[other], pooled)
            at = np.where(more, pos[other], at)
        f, h, mean, top, z = self.heads(pooled, lay)
        n_docs = len(target)
        own = np.repeat(np.arange(n_docs), np.diff(lay.begin))
        dz = ((sigmoid(z) - target) / n_docs).astype(np.float32)
        g = {"o": np.hstack((mean, top)).T @ dz, "ob": dz.sum(keepdims=True)}
        d_mean = dz[:, None] * self.p["o"][:HIDDEN] / np.diff(lay.begin)[:, None]
        d_top = dz[:, None] * self.p["o"][HIDDEN:]
        best = h == top[own]  # chunks that are alike share the maximum
        d_top = d_top / np.add.reduceat(best, lay.begin[:-1], axis=0, dtype=np.float32)
        dh = (d_mean[own] + np.where(best, d_top[own], 0)) * (h > 0)
        g["h"], g["hb"] = f.T @ dh, dh.sum(0)
        df = np.where(f > 0, dh @ self.p["h"].T, 0).astype(np.float32)
        g["kb"] = df.sum(0)
        g["k"] = np.zeros_like(self.p["k"])
        for lo in range(0, len(df), 1024):  # windows of the winning positions, a block of chunks at a time
            code = lay.code[at[lo:lo + 1024, :, None] + np.arange(WIDTH)]
            bits = _BITS[code].reshape(*code.shape[:2], 8 * WIDTH)
            g["k"] += np.einsum("cf,cfk->kf", df[lo:lo + 1024], bits, optimize=True)
        return g


def train_network(texts: list[bytes], target: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """A network fitted with Adam; both labels weigh alike through how often
    their rows are drawn."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    m = {n: np.zeros_like(v) for n, v in net.p.items()}
    s = {n: np.zeros_like(v) for n, v in net.p.items()}
    good, bad = np.flatnonzero(target == 1), np.flatnonzero(target == 0)
    half = BATCH // 2
    steps = max(1, epochs * max(len(good), len(bad)) // half)
    for t in range(1, steps + 1):
        rows = np.concatenate((rng.choice(good, half), rng.choice(bad, half)))
        parts = [texts[i] for i in rows]
        offs = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        g = net.gradients(np.frombuffer(b"".join(parts), np.uint8), offs, target[rows])
        rate = RATE * (1 - (t - 1) / steps)
        for n, v in g.items():
            m[n] += 0.1 * (v - m[n])
            s[n] += 0.001 * (v * v - s[n])
            net.p[n] -= rate * (m[n] / (1 - 0.9 ** t)) / (np.sqrt(s[n] / (1 - 0.999 ** t)) + 1e-7)
    return net


class Constant:
    """What stands for a network when there is one label or none."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.full(len(offs) - 1, self.share)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", sample: int = SAMPLE,
        segment: int = SEGMENT):
    """The model of the documents (doc_id, text) that ``train`` selects and
    that have a label (1 and more counts as 1)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(train)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).alias("label")) \
        .dropna().groupBy("doc_id").agg((F.min("label") >= 1).cast("int").alias("label"))
    known = rows.select("doc_id").join(marks, "doc_id")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return Constant(float(total.get(1, 0)) / max(1, sum(total.values())) if total else 0.5)
    draw = F.xxhash64("doc_id", F.lit(11))
    picked = [known.filter(F.col("label") == q).distinct().orderBy(draw, "doc_id").limit(sample) for q in (0, 1)]
    # 2 * sample ids
    found = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    spare = F.greatest(F.octet_length("text") - segment, F.lit(0))
    place = F.pmod(F.xxhash64("text"), F.coalesce(spare, F.lit(0)).cast("bigint") + 1)
    found = found.select("label", F.substring(raw, place.cast("int") + 1, F.lit(segment)).alias("part"))

    def learn(table: pa.Table) -> pa.Table:
        order = sorted(zip(table.column("label").to_pylist(), table.column("part").to_pylist()))
        net = train_network([p for _, p in order], np.array([q for q, _ in order]))
        return pa.table({"model": pa.array([net.to_bytes()], pa.binary())})

    model = found.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "model binary").first()
    net = Network.from_bytes(model["model"])
    net.p["ob"] += np.float32(np.log(total[1] / total[0]))
    return net


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of the whole text of every row."""
    def run(batches):
        for b in slices(batches, max_bytes=SLICE):
            s = model.scores(*text_buffers(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, score double")


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from (a null id has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id")))
    return score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op11_quality_cnn": op11_quality_cnn}
ORACLE = {}
