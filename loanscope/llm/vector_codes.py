"""Vector code compression (operator 12): product codes by an integer
Walsh-Hadamard transform.

Each component x becomes floor(4096 * x); a vector is cut into ``PARTS`` equal
consecutive parts, and every part position has a codebook of up to ``ENTRIES``
entries.  It starts as the parts of the vectors with the smallest ids; each of
``ROUNDS`` rounds assigns every part to the nearest entry and moves the entries
to the componentwise floor of the mean.  A vector's code is its nearest final
entries.

Nearest entries.  Parts and entries, zero-padded to a power of two P, go
through the integer Walsh-Hadamard transform.  It is orthogonal up to the
factor P: the squared differences of the coefficients add up to exactly P times
the squared distance.  They are added in sequency order (fewest sign changes
first, where the smooth part of a vector lies).  After the first ``HEAD``
coefficients the entry that leads is finished in full; every entry whose sum so
far lies above that bound can no longer win and goes, and so on block by block.
All numbers are integers: 64 bits where the largest possible sum fits, Python
integers otherwise.  Ties go to the lower index.

In Spark.  The integer vectors are written once; each round is one pass over
them in which every task adds up its parts per entry, the sums (bounded by
dimensions x entries per task) are combined in Spark, and the codebooks
(ENTRIES x dimensions integers) go through the driver.  A vector that a third
of all rows share costs no more than another; ids are never shuffled.  Sums
travel as limbs of 32 bits, so they cannot overflow.

Rows whose vector is null or holds a null or non-finite component are dropped.
Vectors shorter than the longest one, and lengths that PARTS does not divide,
are filled up with zeros at the end (an empty vector is all zeros).  Null ids
are kept and come last among the first vectors; equal ids are told apart by
their vectors, in order.  With fewer than ENTRIES vectors the codebooks have
one entry per vector.  Repeated rows get equal codes and count each.  An error
or a sum of errors beyond 64 bits is null.  An empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.tables import read_table, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
HEAD = 2            # coefficients added before the first elimination
CELLS = 1 << 17     # components per step of a task

_SMALL = 1 << 30    # components below this are stored as 32-bit integers
_LIMB = 32


@lru_cache(maxsize=8)
def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Walsh-Hadamard matrix by their number of sign
    changes: row bitreverse(gray(k)) has k of them."""
    k = np.arange(size)
    gray, out = k ^ (k >> 1), np.zeros(size, np.int64)
    for _ in range(size.bit_length() - 1):
        out = (out << 1) | (gray & 1)
        gray = gray >> 1
    return out


def padded_size(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def transform(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients, in sequency order, of the last axis
    (zero-padded to a power of two); integers stay integers."""
    size = parts.shape[-1]
    full = padded_size(size)
    x = np.zeros((*parts.shape[:-1], full), parts.dtype)
    x[..., :size] = parts
    step = 1
    while step < full:
        pairs = x.reshape(*parts.shape[:-1], full // (2 * step), 2, step)
        x = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), -2) \
            .reshape(*parts.shape[:-1], full)
        step *= 2
    return x[..., sequency_order(full)]


def fits(largest: int, size: int) -> bool:
    """Whether sums of squared differences of components up to ``largest``
    stay within 64 bits, scaled by the transform."""
    return 4 * padded_size(size) ** 2 * largest ** 2 < 1 << 62


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every part: entries
    are eliminated as soon as their sum passes the bound."""
    n, size = parts.shape
    if size == 0 or n == 0:
        return np.zeros(n, np.int64), np.zeros(n, parts.dtype)
    a, b = transform(parts), transform(entries)
    full = a.shape[1]
    head = min(HEAD, full)
    part = ((a[:, None, :head] - b[None, :, :head]) ** 2).sum(-1)
    lead = np.argmin(part, 1)
    bound = part[np.arange(n), lead] + ((a[:, head:] - b[lead, head:]) ** 2).sum(-1)
    row, entry = np.nonzero(part <= bound[:, None])
    total = part[row, entry]
    lo = head
    while lo < full:
        hi = min(full, 2 * lo)
        total = total + ((a[row, lo:hi] - b[entry, lo:hi]) ** 2).sum(-1)
        left = total <= bound[row]
        row, entry, total = row[left], entry[left], total[left]
        lo = hi
    # the leader itself is always left: the least of (sum, index) per row
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(total, first)
    counts = np.diff(np.append(first, len(row)))
    wins = np.flatnonzero(total == np.repeat(least, counts))
    keep = wins[np.append(True, row[wins][1:] != row[wins][:-1])]
    return entry[keep], least // full


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite numbers: int64, or Python integers where
    that is too small."""
    flat = flat.astype(np.float64)
    if len(flat) == 0 or np.abs(flat).max() < 2.0 ** 40:
        return np.floor(flat * SCALE).astype(np.int64)
    out = np.empty(len(flat), object)
    # scaling by a power of two is exact short of the largest numbers, which are whole
    out[:] = [int(np.floor(x * SCALE)) if abs(x) < 2.0 ** 1000 else int(x) * SCALE for x in flat.tolist()]
    return out


def _stored(batches, dims: int):
    """Rows (vec_id, label, small, large): little-endian 32-bit components,
    or where they are too large their decimal texts."""
    for b in batches:
        for lo in range(0, b.num_rows, max(1, CELLS // max(1, dims))):
            part = b.slice(lo, max(1, CELLS // max(1, dims)))
            col = part.column(2)
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            size = np.diff(col.offsets.to_numpy())
            v = integers(col.flatten().to_numpy(zero_copy_only=False))
            x = np.zeros((part.num_rows, dims), v.dtype)
            at = np.cumsum(size) - size
            x[np.repeat(np.arange(len(size)), size), np.arange(len(v)) - np.repeat(at, size)] = v
            wide = (np.abs(x) >= _SMALL).any(1) if dims else np.zeros(len(x), bool)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(1),
                 pa.array([None if w else r.astype("<i4").tobytes() for r, w in zip(x, wide)], pa.binary()),
                 pa.array([",".join(map(str, r.tolist())) if w else None for r, w in zip(x, wide)], pa.string())],
                names=["vec_id", "label", "small", "large"])


def _blocks(batches, dims: int):
    """(record batch, integer matrix) steps of stored rows; rows that need
    Python integers come in matrices of their own."""
    for b in batches:
        small = b.schema.get_field_index("small")
        for lo in range(0, b.num_rows, max(1, CELLS // max(1, dims))):
            part = b.slice(lo, max(1, CELLS // max(1, dims)))
            col = part.column(small)
            plain = col.is_valid()
            p = part.filter(plain)
            if p.num_rows:
                raw = b"".join(p.column(small).to_pylist())
                yield p, np.frombuffer(raw, "<i4").reshape(p.num_rows, dims).astype(np.int64)
            q = part.filter(col.is_null())
            if q.num_rows:
                x = np.empty((q.num_rows, dims), object)
                for i, t in enumerate(q.column(small + 1).to_pylist()):
                    x[i] = [int(v) for v in t.split(",")]
                yield q, x


def assigned(x: np.ndarray, books: list[list[list[int]]], largest: int):
    """(indexes, squared distances), rows x parts, of integer vectors;
    ``largest`` bounds the entries' components."""
    n, dims = x.shape
    size = dims // len(books)
    top = max(largest, int(np.abs(x).max())) if x.size else 0
    kind = np.int64 if fits(top, size) else object
    index, dist = [], []
    for p, book in enumerate(books):
        entries = np.array(book, kind).reshape(len(book), size)
        i, d = nearest(x[:, p * size:(p + 1) * size].astype(kind), entries)
        index.append(i)
        dist.append(d)
    return np.stack(index, 1), np.stack(dist, 1)


def _part_sums(batches, dims: int, books, largest: int):
    """Limbs of the sums per (part, entry, position), position -1 for the
    number of parts; one set of rows per task."""
    size = dims // len(books)
    sums: dict = {}
    for _, x in _blocks(batches, dims):
        index, _ = assigned(x, books, largest)
        for p in range(len(books)):
            own = x[:, p * size:(p + 1) * size]
            for e in np.unique(index[:, p]).tolist():
                rows = own[index[:, p] == e]
                add = [len(rows), *(int(v) for v in rows.sum(0))]
                old = sums.get((p, e))
                sums[p, e] = [u + v for u, v in zip(old, add)] if old else add
    out = []
    for (p, e), values in sums.items():
        for at, v in enumerate(values):
            limb = 0
            while True:
                low = v & ((1 << _LIMB) - 1)
                v >>= _LIMB
                out.append((p, e, at - 1, limb, low))
                limb += 1
                if v in (0, -1):
                    break
            if v:
                out.append((p, e, at - 1, limb, -1))
    cols = list(zip(*out)) if out else [[]] * 5
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(cols[4], pa.int64())],
        names=["part", "entry", "position", "limb", "value"])


def _moved(rows, books):
    """The codebooks after a round: floor of the mean, unused entries stay."""
    total: dict = {}
    for r in rows:
        key = (r["part"], r["entry"], r["position"])
        total[key] = total.get(key, 0) + (int(r["value"]) << (_LIMB * r["limb"]))
    return [[[total[p, e, i] // total[p, e, -1] for i in range(len(entry))] if (p, e, -1) in total else entry
             for e, entry in enumerate(book)] for p, book in enumerate(books)]


def _largest(books) -> int:
    return max((abs(v) for book in books for entry in book for v in entry), default=0)


class Compressor:
    """Integer vectors written once, and the codebooks fitted to them."""

    def __init__(self, vectors: DataFrame, dims: int, books: list):
        self.vectors, self.dims, self.books = vectors, dims, books

    @classmethod
    def start(cls, rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS,
              entries: int = ENTRIES) -> Compressor | None:
        """Integer vectors of the kept rows; None when there are none."""
        v = rows[vector_col]
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        kept = rows.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(
            rows[id_col].cast("bigint").alias("vec_id"), rows[label_col].alias("label"), v.alias("v"))
        longest = kept.agg(F.max(F.size("v"))).first()[0]
        if longest is None:
            return None
        dims = -(-longest // parts) * parts
        kind = kept.schema["label"].dataType.simpleString()
        stored = written(kept.mapInArrow(lambda b: _stored(b, dims),
                                         f"vec_id bigint, label {kind}, small binary, large string"), "vectors")
        first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
        vectors = [integers(np.array(r["v"], np.float64)).tolist() for r in first]
        vectors = [u + [0] * (dims - len(u)) for u in vectors]
        size = dims // parts
        return cls(stored, dims, [[u[p * size:(p + 1) * size] for u in vectors] for p in range(parts)])

    def fit(self, rounds: int = ROUNDS) -> Compressor:
        for _ in range(rounds):
            sums = self.vectors.select("small", "large").mapInArrow(
                partial(_part_sums, dims=self.dims, books=self.books, largest=_largest(self.books)),
                "part int, entry int, position int, limb int, value bigint",
            ).groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value"))
            self.books = _moved(sums.collect(), self.books)  # dims x entries sums
        return self

    def digest(self) -> str:
        text = ",".join(str(v) for book in self.books for entry in book for v in entry)
        return hashlib.sha256(text.encode()).hexdigest()

    def codes(self) -> DataFrame:
        """vec_id, label, code (array of indexes) and error of every vector."""
        books, dims, top = self.books, self.dims, _largest(self.books)
        most = (1 << 63) - 1

        def run(batches):
            for b, x in _blocks(batches, dims):
                index, dist = assigned(x, books, top)
                # within 64 bits the parts' distances may still add up to more
                wide = [sum(d) for d in dist.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(index.tolist(), pa.list_(pa.int32())),
                     pa.array([w if w <= most else None for w in wide], pa.int64())],
                    names=["vec_id", "label", "code", "error"])

        kind = self.vectors.schema["label"].dataType.simpleString()
        return self.vectors.mapInArrow(run, f"vec_id bigint, label {kind}, code array<int>, error bigint")


def with_group_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal ``key`` (nulls equal);
    null where a value is null or the sum leaves 64 bits.  The sums are added
    up per task first and joined back: no group lies in one task."""
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    whole = F.when(F.count(F.lit(1)) == F.count(value), total).try_cast("bigint")
    sums = rows.groupBy(F.col(key).alias("_sum_key")).agg(whole.alias(out))
    return rows.join(sums, rows[key].eqNullSafe(sums["_sum_key"])).drop("_sum_key")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    found = Compressor.start(rows, "vec_id", "embedding", "label")
    schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if found is None:
        return spark.createDataFrame([], schema)
    found.fit()
    digits = F.concat_ws("", F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")))
    codes = written(found.codes().select("vec_id", "label", digits.alias("code"), "error"), "codes")
    return with_group_sum(codes, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The definition in DuckDB SQL: whole distances, no transform."""
    steps = [f"""kept AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""comps AS MATERIALIZED (
    SELECT rid, (i - 1) // (len(v) // {PARTS}) AS p, (i - 1) % (len(v) // {PARTS}) AS k, v[i] AS x
    FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS i FROM kept))""",
             f"book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, k, x AS c FROM comps WHERE rid <= {ENTRIES})"]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
    SELECT rid, p, min_by(e, d * 100 + e) AS e, min(d) AS d
    FROM (SELECT rid, p, e, sum((x - c) * (x - c)) AS d FROM comps JOIN book{r} USING (p, k) GROUP BY rid, p, e)
    GROUP BY rid, p)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
    SELECT p, e, k, coalesce((s - ((s % n) + n) % n) // n, c) AS c
    FROM book{r} LEFT JOIN (SELECT p, e, k, sum(x) AS s, count(*) AS n
                            FROM comps JOIN near{r} USING (rid, p) GROUP BY p, e, k) USING (p, e, k))""")
    return f"""WITH {", ".join(steps)},
digest AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k)) AS h FROM book{ROUNDS}),
coded AS (SELECT rid, string_agg(format('{{:02x}}', CAST(e AS BIGINT)), '' ORDER BY p) AS code, sum(d) AS error
          FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (rid) CROSS JOIN digest"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE = {"op12_vector_codes": _oracle()}
