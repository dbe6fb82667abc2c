"""Substring dedup (operator 8): repeated token windows are removed.

Every window of ``window`` consecutive words gets a Rabin-Karp hash (a
polynomial over the words' 64-bit hashes, read from one running sum), all
windows of the corpus are counted in Spark by that hash (``repeats``), and in
each text the windows found more than once merge into maximal intervals of
words, which are removed.  Windows are judged on the input; the first
occurrence goes as well.

A hash held by a third of all windows costs one entry per slice of texts.
Hashes have 64 bits: of N different windows about N**2 / 2**64 share theirs with
another by chance (one in 10**10 of 10**9 windows, some five of 10**10).

Null and empty texts and texts with fewer words than a window lose nothing.
A row that repeats in full is an occurrence of its own: all its windows then
start elsewhere too, and go (doc_id names a text; rows of one doc_id must
agree on it).  A row with a null doc_id is a text of its own.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.repeats import buckets_for, packed_texts, repeated, total_bytes, unpacked, with_found
from loanscope.llm.tables import read_table, with_columns_free, with_null_ids
from loanscope.llm.textbatch import SLICE_BYTES, Rolling, mix64, runs, slices, text_buffers, word_hashes, words

WINDOW = 35


def window_hashes(data: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the word windows of every text."""
    start, end, bounds = words(data, offs)
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    cut = np.concatenate(([0], np.cumsum(n)))
    if cut[-1] == 0:
        return np.zeros(0, np.uint64), cut
    first = np.arange(cut[-1]) + np.repeat(bounds[:-1] - cut[:-1], n)
    roll = Rolling(word_hashes(data, start, end), base=0xC2B2AE3D27D4EB4F)
    return mix64(roll.of(first, first + window)), cut


def join_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The words of every text joined by one space."""
    size = end - start + 1
    to = np.concatenate(([0], np.cumsum(size)))
    src = np.arange(to[-1]) + np.repeat(start - to[:-1], size)
    out = np.append(data, np.uint8(0x20))[src]
    out[to[1:] - 1] = 0x20
    raw = out.tobytes()
    return [raw[a:max(a, b - 1)] for a, b in zip(to[bounds[:-1]].tolist(), to[bounds[1:]].tolist())]


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (array of word intervals start,
    end) and kept_text (the kept words joined by one space)."""
    return with_null_ids(with_columns_free(docs, id_col, text_col), lambda rows: _substring_dedup(rows, window))


def _substring_dedup(rows: DataFrame, window: int) -> DataFrame:
    found = repeated(rows, lambda col: window_hashes(*text_buffers(col), window), buckets_for(total_bytes(rows)))

    def cut(batches):
        for part in slices(batches, "z", SLICE_BYTES // 3):
            texts = unpacked(part.column(1))
            data = np.frombuffer(b"".join(texts), np.uint8)
            offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
            start, end, bounds = words(data, offs)
            hit = np.zeros(len(start) + 1, np.int64)
            for row, blobs in enumerate(part.column(2).to_pylist()):
                if blobs:
                    first = bounds[row] + np.frombuffer(b"".join(blobs), "<i4").astype(np.int64)
                    first = np.unique(first)
                    hit[first] += 1
                    hit[first + window] -= 1
            gone = np.cumsum(hit[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            keep = ~gone
            kept_bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
            spans = []
            for row in range(part.num_rows):
                a, e = runs(gone[bounds[row]:bounds[row + 1]])
                spans.append(np.stack((a, e), 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds), pa.int64()),
                 pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()),
                 pa.array(spans, pa.list_(pa.int32())),
                 pa.array(join_words(data, start[keep], end[keep], kept_bounds), pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept_text"])

    return with_found(packed_texts(rows), found, ["idx"]).mapInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, removed array<int>, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE = {}
