"""Conversation prefix trie (operator 13) by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations
that begin with it.  Training on the trie instead of the conversations pays for
each shared prefix once: ``saved_tokens`` is what a subtree saves.

1. Turns get their place in their conversation (a numbering over range
   partitions, so a conversation of any length is cut over tasks).  The
   sequence of first d turns is known by the sum over its turns of 128 bits of
   SHA-256 of (place, role, text), piece by piece modulo 2**32: sums of prefixes
   are running sums, taken in blocks, and equal sequences have equal sums
   (unequal ones share them with a probability of about N**2 / 2**129).  Grouping by
   depth and sum gives the nodes.
2. Nodes are numbered by (depth, parent, smallest member): the children of a
   node are neighbours.  From the first and last child of a node and of its
   parent follow the links of the Euler tour: every node has an arc that enters
   and one that leaves it.
3. The tour is ranked as a linked list (``order_sums.list_ranks``): rounds of
   independent elements taken out, then put back.  The depth of the trie does
   not matter, neither does the number of children of a node.
4. Entering arcs carry 1 if the node has no children, and what it saves.
   With running sums along the tour, the sum over a subtree is the sum at its
   leaving arc minus the sum before its entering arc.

``ends_sha256`` is a hash of one text per node, so it is a sequential thing; ids
are sorted by ranges, joined to texts of up to ``CHUNK`` ids, and each node's few
texts are streamed through the hash in order, so memory stays bounded.

Turns are ordered by turn (null first), then role and text, so repeated turns
have a defined order; null roles and texts are empty.  Rows with a null conv_id
belong to no conversation and are ignored.  ``%`` keeps the sign of the id, as
in SQL.  An empty table has no nodes, not even a root.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanscope.llm.order_sums import list_ranks, ranked, running_sums
from loanscope.llm.tables import read_table, written

PIECES = ["p0", "p1", "p2", "p3"]
CHUNK = 4096  # ids per text
WORD = 1 << 32


def placed_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place 1.., content, n_bytes) of every turn with a conv_id;
    content is the SHA-256 of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        role.alias("role"), text.alias("text"))
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = ranked(rows, [F.col(c) for c in ("conv_id", "turn", "role", "text")],
                  [F.col("conv_id"), content.alias("content"), F.octet_length("text").cast("bigint").alias("n_bytes")])
    return written(rows, "turns")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, first, n): rank of the first turn and number of turns."""
    return turns.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))


def as_given(turns: DataFrame) -> DataFrame:
    """(conv_id, place, content, n_bytes, length): the conversations as they
    are."""
    return turns.join(conversations(turns), "conv_id").select(
        "conv_id", (F.col("rank") - F.col("first") + 1).alias("place"), "content", "n_bytes", F.col("n").alias("length"))


def rebuilt(turns: DataFrame, siblings: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from a neighbour: conversation c
    gets the first h turns of conversation c - c % siblings, then its own from
    h + 1 on; h is crc32(decimal c) % (most + 1).

    Returns (conv_id, length) of all conversations, and the turns as
    ``as_given`` does (length left out)."""
    convs = conversations(turns)
    base = F.col("conv_id") - F.col("conv_id") % siblings
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    bases = convs.filter(F.col("conv_id") % siblings == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = convs.withColumns({"base": base, "h": h}).join(bases, "base", "left") \
        .withColumn("taken", F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))) \
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = written(plan, "plan")
    at = F.col("rank") - F.col("first") + 1
    own = turns.join(plan, "conv_id").filter(at > F.col("h")).select(
        "conv_id", (F.col("taken") + at - F.col("h")).alias("place"), "content", "n_bytes")
    # at most ``most`` turns of a base, at most 2 * siblings - 1 takers
    heads = turns.filter(F.col("conv_id") % siblings == 0).join(convs, "conv_id") \
        .select(F.col("conv_id").alias("base"), at.alias("place"), "content", "n_bytes").filter(F.col("place") <= most)
    taken = heads.join(plan.select("conv_id", "base", "taken"), "base").filter(F.col("place") <= F.col("taken"))
    return plan.select("conv_id", "length"), own.unionByName(taken.select(own.columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p0..p3, q0..q3, n_bytes) of every prefix: the sums up
    to its last turn (p) and up to the turn before (q)."""
    whole = F.sha2(F.concat_ws("/", F.col("place").cast("string"), "content"), 256)
    piece = [F.conv(F.substring(whole, 8 * i + 1, 8), 16, 10).cast("bigint").alias(p) for i, p in enumerate(PIECES)]
    rows = turns.select("conv_id", (F.col("place") - 1).alias("at"), "n_bytes", *piece)
    rows = written(rows.select("*", *[F.col(p).alias(f"own_{p}") for p in PIECES]), "pieces")
    sums = running_sums(rows, ["conv_id"], "at", PIECES, modulus=WORD)
    before = [F.pmod(F.col(p) - F.col(f"own_{p}"), F.lit(WORD)).alias(p.replace("p", "q")) for p in PIECES]
    return sums.select("conv_id", (F.col("at") + 1).alias("depth"), *PIECES, *before, "n_bytes")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, p0..p3, ends_sha256) of rows (conv_id, depth, p0..p3): the
    conversations that end at a node, hashed in ascending order."""
    key = ["depth", *PIECES]
    spec = ", ".join(f"{c} bigint" for c in key)

    def chunk(batches):
        last, first, ids = None, None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in last] + [pa.array([first], pa.int64()),
                                                             pa.array([",".join(map(str, ids))], pa.string())],
                names=[*key, "first", "ids"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in [*key, "conv_id"])):
                if last is not None and (row[:-1] != last or len(ids) == CHUNK):
                    yield out()
                    ids = []
                if not ids:
                    last, first = row[:-1], row[-1]
                ids.append(row[-1])
        if ids:
            yield out()

    def digest(batches):
        last, h = None, None
        for b in batches:
            keys, found = [], []
            for row in zip(*(b.column(c).to_pylist() for c in [*key, "ids"])):
                if row[:-1] != last:
                    if last is not None:
                        keys.append(last)
                        found.append(h.hexdigest())
                    last, h = row[:-1], hashlib.sha256()
                else:
                    h.update(b",")
                h.update(row[-1].encode())
            yield _digests(keys, found)
        if last is not None:
            yield _digests([last], [h.hexdigest()])

    def _digests(keys, found):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.int64()) for i in range(len(key))] + [pa.array(found, pa.string())],
            names=[*key, "ends_sha256"])

    texts = rows.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id") \
        .mapInArrow(chunk, f"{spec}, first bigint, ids string")
    return texts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{spec}, ends_sha256 string")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """Links (id, prev, next) of the tour of a tree given as (node, parent,
    first_child, last_child, first_sibling, last_sibling); arc 2n enters node
    n, arc 2n + 1 leaves it.  Siblings have neighbouring numbers."""
    into, out = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    leaf, root = F.col("first_child").isNull(), F.col("parent").isNull()
    enter = F.struct(
        into("node").alias("id"),
        F.when(root, None).when(F.col("node") == F.col("first_sibling"), into("parent"))
        .otherwise(out("node") - 2).alias("prev"),
        F.when(leaf, out("node")).otherwise(into("first_child")).alias("next"))
    leave = F.struct(
        out("node").alias("id"),
        F.when(leaf, into("node")).otherwise(out("last_child")).alias("prev"),
        F.when(root, None).when(F.col("node") == F.col("last_sibling"), out("parent"))
        .otherwise(into("node") + 2).alias("next"))
    return nodes.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, length) with turns (conv_id,
    place 1.., content, n_bytes)."""
    steps = written(prefixes(turns), "prefixes")
    key = ["depth", *PIECES]
    zero = [F.lit(0).cast("bigint").alias(p) for p in PIECES]
    nodes = steps.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        *[F.max(f"q{i}").alias(f"q{i}") for i in range(len(PIECES))])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0") \
        .select("conv_id", "n_convs", F.lit(0).cast("bigint").alias("depth"), *zero,
                F.lit(0).cast("bigint").alias("n_bytes"), *[z.alias(f"q{i}") for i, z in enumerate(zero)])
    nodes = written(nodes.unionByName(root), "nodes")

    ends = steps.join(convs.filter("length > 0"), "conv_id").filter(F.col("depth") == F.col("length")) \
        .select("conv_id", *key)
    ends = ends.unionByName(convs.filter("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("depth"), *zero))
    ends = _ends(ends)

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                           *[F.col(p).alias(p.replace("p", "q")) for p in PIECES])
    named = nodes.join(parents, ["depth", "q0", "q1", "q2", "q3"], "left").join(ends, key, "left").select(
        "depth", "parent_conv_id", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saves"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    order = [F.col(c) for c in ("depth", "parent_conv_id", "conv_id")]
    named = written(ranked(named, order, [F.col(c) for c in named.columns], "node"), "named")

    # (depth, conv_id) is a node's name: a conversation lies on one node per depth
    families = written(named.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"),
                                                         F.col("parent_conv_id").alias("conv_id"))
                       .agg(F.min("node").alias("first_child"), F.max("node").alias("last_child"),
                            F.count(F.lit(1)).alias("n_children")), "families")
    named = written(named.join(families, ["depth", "conv_id"], "left"), "numbered")
    above = named.filter(F.col("n_children") > 0).select(
        (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("node").alias("parent"),
        F.col("first_child").alias("first_sibling"), F.col("last_child").alias("last_sibling"))
    place = list_ranks(euler_tour(named.join(above, ["depth", "parent_conv_id"], "left")))

    worth = named.select((F.col("node") * 2).alias("id"), F.col("first_child").isNull().cast("bigint").alias("leaves"), "saves")
    arcs = place.join(worth, "id", "left").select(
        "id", "pos", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saves", F.lit(0)).alias("saves"))
    sums = running_sums(written(arcs, "arcs"), [], "pos", ["leaves", "saves"])
    # at the leaving arc minus at the entering arc: all of the subtree but the node itself
    sign = F.when(F.col("id") % 2 == 1, 1).otherwise(-1)
    inner = sums.groupBy(F.expr("id div 2").alias("node")).agg(
        F.sum(sign * F.col("leaves")).alias("leaves"), F.sum(sign * F.col("saves")).alias("inner_saves"))
    return named.join(inner, "node").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        (F.col("leaves") + F.col("first_child").isNull().cast("bigint")).alias("n_leaves"),
        (F.col("inner_saves") + F.col("saves")).alias("saved_tokens"), "ends_sha256")


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text) as they
    are."""
    turns = placed_turns(rows)
    given = as_given(turns)
    return trie(conversations(turns).select("conv_id", F.col("n").alias("length")), given.drop("length"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(placed_turns(read_table(spark, sf_dir, "conversations"))))


#: The definition in DuckDB SQL: nodes are lists of turns, a subtree is found by
#: comparing prefixes; crc32 bit by bit (its polynomial, reflected, is fixed).
_ORACLE = """
WITH RECURSIVE turns AS MATERIALIZED (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (
    SELECT i, i AS v, 0 AS n FROM range(256) AS x(i)
    UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, n + 1 FROM bits WHERE n < 8),
crc_table AS MATERIALIZED (SELECT i, v FROM bits WHERE n = 8),
crc AS (
    SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, CAST(4294967295 AS BIGINT) AS acc, 0 AS j FROM turns
    UNION ALL
    SELECT conv_id, digits, xor(acc >> 8, v), j + 1
    FROM crc JOIN crc_table ON i = xor(acc, ascii(substring(digits, j + 1, 1))) & 255
    WHERE j < length(digits)),
taken AS (SELECT conv_id, xor(acc, 4294967295) % 9 AS h FROM crc WHERE j = length(digits)),
whole AS MATERIALIZED (
    SELECT a.conv_id, coalesce(b.own[1:h], []) || a.own[h + 1:] AS s
    FROM turns a JOIN taken USING (conv_id) LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 5),
member AS (SELECT conv_id, s[1:d] AS k, d, len(s) = d AS ends
           FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM whole)),
node AS MATERIALIZED (
    SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * coalesce(strlen(k[d].t), 0) AS saves,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS h
    FROM member GROUP BY k, d),
family AS MATERIALIZED (
    SELECT n.*, p.conv_id AS parent_conv_id,
           (SELECT count(*) FROM node c WHERE c.d = n.d + 1 AND c.k[1:n.d] = n.k) AS n_children
    FROM node n LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1])
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saves) AS BIGINT) AS saved_tokens,
       a.h AS ends_sha256
FROM family a JOIN family b ON b.d >= a.d AND b.k[1:a.d] = a.k
GROUP BY a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.h
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE = {"op13_prefix_trie": _ORACLE}
