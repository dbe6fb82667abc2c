"""Quality rules (operator 9) with risk-controlled thresholds.

Counts (``quality_counts``) come from the whole text of every document.
Cutoffs (``fit_cutoffs``) come from labelled documents; ``quality_rules``
applies both.

Method.  Labelled documents that pass the base rule are split by a hash of
doc_id.  In one half, for every stratum (language) and every rule (a ratio of
two counts where large values are suspicious, ``RULES``), the upper quantiles
of the good documents (quality 1) at the tail levels ``LEVELS`` propose
cutoffs.  A level is thus one choice for a stratum: reject a document if any
rule lies above its cutoff of that level; later levels reject more.

The other half, the holdout, certifies.  A level must not reject more than a
share ``alpha`` of the stratum's good documents: with n good holdout
documents of which x are rejected, the exact binomial (Clopper-Pearson)
p-value of "the false rejection rate is over alpha" is P(Bin(n, alpha) <= x).
Levels are tested from the mildest on and testing stops at the first that is
not certified (fixed-sequence testing, which needs no correction within a
stratum); over the strata the level is Bonferroni-corrected, ``delta`` divided
by their number.  So with probability 1 - delta every stratum keeps all but
alpha of its good documents.  Of the certified levels the mildest is taken
that rejects nearly as many bad holdout documents (quality 0) as any
certified one (a share ``NEARLY``).  A stratum with too few labels, or where
no certified level rejects a bad document, rejects nothing beyond the base
rule.

Only numbers bounded by strata x rules x levels reach the driver: the
proposed cutoffs, and the holdout's histogram over levels.  Strata are
languages, a set that does not grow with the documents.

Null text: no words, n_words 0, the base rule fails.  A null language is the
stratum "".  Documents whose ratio has no denominator count as 0.  Labels of
unknown documents, null or repeated labels: unknown ones are dropped by the
join, nulls ignored, of repeated ones the smallest quality counts.  Without
labels nothing is certified and only the base rule rejects.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.tables import read_table, with_null_ids, without, written
from loanscope.llm.textbatch import ids_of, mix64, owner, slices, text_buffers, word_hashes, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COUNT_SCHEMA = "doc_id bigint, stratum string, " + ", ".join(f"{c} bigint" for c in COUNTS) + \
    ", n_lines bigint, n_upper bigint"

# Rules: name -> (numerator, denominator); a document is suspicious when the
# ratio is large.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "upper": ("n_upper", "word_chars"),
}

ALPHA = 0.04   # largest share of good documents lost per stratum
DELTA = 0.05   # probability that any stratum loses more
NEARLY = 0.98
# Tail levels of the good documents, mildest first.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.012, 0.016)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] - total[offs[:-1]]


def _dup_lines(data: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(lines with a word, those equal to an earlier line) of every text."""
    n_docs = len(offs) - 1
    breaks = np.flatnonzero(data == 0x0A)
    # line starts: text starts and the byte after each newline
    lo = np.concatenate((offs[:-1], breaks + 1))
    doc = np.concatenate((np.arange(n_docs), np.searchsorted(offs, breaks, side="right") - 1))
    order = np.lexsort((lo, doc))
    lo, doc = lo[order], doc[order]
    last = np.append(doc[1:] != doc[:-1], True)
    hi = np.where(last, offs[doc + 1], np.append(lo[1:], 0) - 1)
    filled = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    lo, hi, doc = lo[filled], hi[filled], doc[filled]
    lines = np.bincount(doc, minlength=n_docs)
    h = word_hashes(data, lo, hi)
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return lines, np.bincount(doc[order][1:][same], minlength=n_docs)


def _repeat_words(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words inside a 3-word window found twice or more in its text."""
    n_docs = len(bounds) - 1
    if len(h) < 3:
        return np.zeros(n_docs, np.int64)
    doc = owner(bounds)
    win = np.flatnonzero(doc[2:] == doc[:-2])
    key = mix64(h[win] + mix64(h[win + 1] + np.uint64(1)) + mix64(mix64(h[win + 2]) + np.uint64(2)))
    order = np.lexsort((key, doc[win]))
    k, d = key[order], doc[win][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(h) + 1, np.int64)
    first = win[order[twice]]
    np.add.at(hit, first, 1)
    np.add.at(hit, first + 3, -1)
    return np.bincount(doc[np.cumsum(hit[:-1]) > 0], minlength=n_docs)


def count_batch(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of a batch."""
    start, end, bounds = words(data, offs)
    lead = (data & 0xC0) != 0x80  # one true byte per code point
    cum = np.concatenate(([0], np.cumsum(lead)))
    chars = np.concatenate(([0], np.cumsum(cum[end] - cum[start])))
    lines, dup = _dup_lines(data, offs, start, end)
    return {
        "n_words": np.diff(bounds),
        "word_chars": chars[bounds[1:]] - chars[bounds[:-1]],
        "n_symbols": _sums(_SYMBOL[data], offs),
        "n_dup_lines": dup,
        "n_repeat_words": _repeat_words(word_hashes(data, start, end), bounds),
        "n_lines": lines,
        "n_upper": _sums((data >= 65) & (data <= 90), offs),
    }


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every document's whole text."""
    stratum = F.coalesce(docs[stratum_col].cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), stratum.alias("stratum"),
                       docs[text_col].alias("text"))

    def run(batches):
        for b in slices(batches):
            found = count_batch(*text_buffers(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.string())]
                + [pa.array(found[c].astype(np.int64)) for c in [*COUNTS, "n_lines", "n_upper"]],
                names=["doc_id", "stratum", *COUNTS, "n_lines", "n_upper"],
            )

    return rows.mapInArrow(run, _COUNT_SCHEMA)


def base_failed():
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str):
    top, bottom = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom)).otherwise(F.lit(0.0))


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), exact sum in log space."""
    if x >= n:
        return 1.0
    k = np.arange(x + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k]) \
        + k * math.log(p) + (n - k) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def certified_levels(rejected, n: int, alpha: float, level: float) -> int:
    """How many levels pass, tested in order up to the first that fails;
    ``rejected[i]`` of n good holdout documents are rejected by level i."""
    for i, x in enumerate(rejected):
        if n == 0 or binomial_cdf(int(x), n, alpha) > level:
            return i
    return len(rejected)


def fit_cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                levels=LEVELS) -> dict[str, dict[str, float]]:
    """Certified cutoffs: stratum -> rule -> ratio above which a document is
    rejected."""
    quality = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = (
        counts.filter(~base_failed()).join(quality, "doc_id")
        .select("doc_id", "stratum", (F.col("quality") >= 1).alias("good"),
                (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("holdout"),
                *[_ratio(r).alias(r) for r in RULES])
    )
    proposal = rows.filter("good AND NOT holdout").groupBy("stratum").agg(
        *[F.percentile_approx(r, [1.0 - t for t in levels], 10000).alias(r) for r in RULES]
    )
    cuts = {p["stratum"]: {r: list(p[r]) for r in RULES} for p in proposal.collect()}
    # the first level that rejects a document: cutoffs fall with the level,
    # so it is the number of cutoffs at or above the ratio
    # (the cutoffs, strata x rules x levels numbers, are part of the expression:
    # a stratum that holds most rows is not brought together)
    known = F.create_map(*[x for s in sorted(cuts) for x in (F.lit(s), F.struct(
        *[F.array(*[F.lit(float(c)) for c in cuts[s][r]]).alias(r) for r in RULES]))]) if cuts else None
    if known is None:
        return {}
    held = rows.filter("holdout").withColumn("cut", known[F.col("stratum")]).filter("cut IS NOT NULL")
    first = F.least(*[F.expr(f"size(filter(cut.{r}, c -> c >= {r}))") for r in RULES])
    cells = held.groupBy("stratum", "good", first.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    seen = {s: np.zeros((2, len(levels) + 1), int) for s in cuts}
    for c in cells.collect():
        seen[c["stratum"]][int(c["good"])][c["first"]] += c["n"]
    out = {}
    for stratum, (bad, good) in seen.items():
        passed = certified_levels(np.cumsum(good[:-1]), int(good.sum()), alpha, delta / len(seen))
        caught = np.cumsum(bad[:-1])[:passed]
        if passed and caught[-1] > 0:
            i = int(np.argmax(caught >= NEARLY * caught[-1]))
            out[stratum] = {r: float(cuts[stratum][r][i]) for r in RULES}
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                  levels=LEVELS) -> DataFrame:
    """Counts, base_failed, kept and the failed rules of every document."""
    counts = written(quality_counts(docs), "quality")
    cutoffs = fit_cutoffs(counts, labels, alpha, delta, levels)
    failed = [
        F.when((F.col("stratum") == s) & (_ratio(rule) > F.lit(cut)), F.lit(rule))
        for s, cuts in sorted(cutoffs.items()) for rule, cut in cuts.items()
    ]
    return (
        counts.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", F.concat_ws(",", *failed) if failed else F.lit(""))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, all columns.  A row
    with a null doc_id is judged by its own text; it has no label."""
    def kept(docs: DataFrame) -> DataFrame:
        return without(docs, quality_rules(docs, labels).select("doc_id", "kept"))

    return with_null_ids(docs, kept, labels)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "failed_rules")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE = {}
