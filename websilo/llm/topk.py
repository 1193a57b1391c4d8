"""Exact top-k inner products of integer vectors.

Candidates are cut into blocks by descending length, with ties in length spread
over blocks by a hash.  A query's score with the longest vectors gives a first
threshold; it then visits only blocks whose longest vector could still reach it
(Cauchy-Schwarz).  Inside a block, candidates come in descending length; vectors
are rotated by the singular vectors of a bounded sample, so that the first
coordinates hold most of the length, and a partial sum over those plus the
product of the residual lengths bounds every score from above.  Only pairs whose
bound reaches the query's threshold are scored, in whole numbers.

Queries meet blocks of candidates on a grid of blocks and query groups, so no task
holds more than one block and one group.  Queries that need few blocks, by the ratio
of threshold to length, are in groups of their own, and a block goes only to groups
with a query that reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows that fit the rotation and the first thresholds; results don't depend on them.
SAMPLE_ROWS, FIRST_ROWS = 4096, 2048
BLOCK_ROWS, GROUP_ROWS = (1024, 32768), (2048, 16384)
#: Ranges of length that blocks are cut by; with more blocks, a range is dealt into several by a hash.
RANGES = 512


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, v, n2): floor(scale * x) of each component as long, and the squared length.

    Null vectors, vectors with null or non-finite components and rows without an
    id are left out; an empty vector scores 0 with all.  Components stay whole, whatever
    their size.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return (
        rows.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .withColumn("n2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    )


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as integers, short ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, dim), np.int64)
    owner = np.repeat(np.arange(n), sizes)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Block:
    """Candidates in descending length, with rotated heads and residual lengths."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, head: int):
        order = np.lexsort((ids, -(vectors.astype(float) ** 2).sum(1)))
        self.ids, self.vectors = ids[order], vectors[order]
        self.rotation, self.head = rotation, head
        self.heads, self.rest, self.length = self.rotated(self.vectors)

    def rotated(self, vectors: np.ndarray):
        v = vectors.astype(float)
        r = v @ self.rotation
        return r[:, : self.head], np.sqrt((r[:, self.head :] ** 2).sum(1)), np.sqrt((v**2).sum(1))

    def search(self, qid: np.ndarray, q: np.ndarray, least: np.ndarray, k: int, step: int = 1024):
        """For each query, (scores, ids) of its k best here among those of at least ``least``."""
        heads, rest, length = self.rotated(q)
        least = least.copy()
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qid]
        exact_in_float = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) < 2**52
        for lo in range(0, len(self.ids), step):
            c = slice(lo, lo + step)
            reach = length * self.length[lo]
            live = np.flatnonzero(reach + 1e-6 * (1 + reach) >= least)
            if not len(live):
                continue  # the rest is shorter, but a query may be live again only if it was now
            bound = heads[live] @ self.heads[c].T + rest[live, None] * self.rest[None, c]
            slack = 1e-6 * (1.0 + length[live, None] * self.length[None, c])
            row, col = np.nonzero(bound + slack >= least[live, None])
            if not len(row):
                continue
            if exact_in_float and len(row) > bound.size // 8:
                score = (q[live].astype(float) @ self.vectors[c].T.astype(float))[row, col].astype(np.int64)
            else:
                score = np.empty(len(row), np.int64)
                for i in range(0, len(row), 16384):
                    s = slice(i, i + 16384)
                    score[s] = (q[live[row[s]]] * self.vectors[lo + col[s]]).sum(1)
            heads_of = np.searchsorted(row, np.arange(len(live) + 1))
            for i in np.unique(row).tolist():
                part = slice(heads_of[i], heads_of[i + 1])
                at = int(live[i])
                s, d = score[part], self.ids[lo + col[part]]
                other = (d != qid[at]) & (s >= least[at])
                s, d = np.append(kept[at][0], s[other]), np.append(kept[at][1], d[other])
                best = _best(s, d, k)
                kept[at] = s[best], d[best]
                if len(best) == k:
                    least[at] = max(least[at], float(kept[at][0][-1]))
        return kept


def top_inner_products(rows: DataFrame, k: int = 20, every: int = 20, head: int = 16,
                       id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query, ties to the smaller vec_id.

    Queries: rows whose id is divisible by ``every``; candidates: every row with
    another id, repeated rows each for itself.  Query rows equal in id and vector
    are answered once.  Vectors of unequal length are filled with zeros.  Scores are
    exact; where the two longest vectors of different ids might have a score that fits no long, that is an error.  Other
    columns of rows play no part, whatever their names.  An empty table gives no rows.
    """
    every_row = whole_vectors(rows, id_col, vector_col, scale)
    n, dim, n_queries, most = every_row.agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.col("vec_id") % every == 0, 1)),
        F.coalesce(F.max("n2"), F.lit(0.0))).first()
    if most > 2.0**63 * 0.999:  # scores are of rows of different ids, so none is above the product of the two largest lengths of different ids
        two = [r["m"] for r in every_row.groupBy("vec_id").agg(F.max("n2").alias("m")).orderBy(F.desc("m")).limit(2).collect()]
        if (two[0] * two[-1]) ** 0.5 > 2.0**63 * 0.999:
            raise ValueError("inner products of these vectors don't fit a long: scale them down")
    dim = max(int(dim), 1)
    head = min(head, dim)
    part = every_row.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1))))
    sample = _matrix(pa.array([r["v"] for r in part.select("v").collect()], pa.list_(pa.int64())), dim)
    rotation = np.linalg.eigh(sample.astype(float).T @ sample.astype(float))[1][:, ::-1].copy()
    longest = every_row.orderBy(F.desc("n2"), "vec_id").limit(FIRST_ROWS).collect()
    first = Block(np.array([r["vec_id"] for r in longest], np.int64),
                  _matrix(pa.array([r["v"] for r in longest], pa.list_(pa.int64())), dim), rotation, head)

    block_rows = int(np.clip(n // 24, *BLOCK_ROWS))
    n_blocks = max(1, -(-int(n) // block_rows))
    n_groups = max(1, -(-int(n_queries) // int(np.clip(n_queries // 16, *GROUP_ROWS))))
    n_ranges = min(n_blocks, RANGES)
    parts = -(-n_blocks // n_ranges)

    def borders(df, column, cuts: list[float]):
        edges = df.agg(F.percentile_approx(column, cuts, 100 * len(cuts))).first()[0] if cuts else None
        return F.array(*[F.lit(float(b)) for b in edges]) if edges else F.array().cast("array<double>")

    edges = borders(every_row, "n2", [1.0 - i / n_ranges for i in range(1, n_ranges)])
    n2, spread = F.col("n2"), F.xxhash64("vec_id", "v")
    above = F.size(F.filter(edges, lambda b: b > n2))
    equal = F.size(F.filter(edges, lambda b: b == n2))
    blocks = every_row.withColumn("range", (above + F.pmod(spread, equal + 1)).cast("int")).withColumn(
        "block", (F.col("range") * parts + F.pmod(F.shiftright(spread, 20), F.lit(parts))).cast("int"))
    longest_of = {r["range"]: r["m"] for r in blocks.groupBy("range").agg(F.max("n2").alias("m")).collect()}
    reach = F.array(*[F.lit(float(longest_of.get(i, -1.0))) for i in range(n_ranges)])

    shared = rows.sparkSession.sparkContext.broadcast(first)

    def thresholds(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                found = shared.value.search(ids, _matrix(batch.column("v"), dim), np.full(len(ids), -np.inf), k)
                least = [float(s[-1]) if len(s) == k else None for s, _ in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.float64())], names=[*batch.schema.names, "least"])

    queries = every_row.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = cut(queries.mapInArrow(thresholds, "vec_id long, v array<bigint>, n2 double, least double"))
    far = lambda r, i: (r >= 0) & (F.col("least").isNull() | (F.sqrt(F.col("n2") * r) * (1 + 1e-9) + 1e-6 >= F.col("least")))
    to = F.filter(F.transform(reach, lambda r, i: F.when(far(r, i), i)), lambda i: i.isNotNull())
    # queries that need few blocks stand together
    ratio = F.coalesce(F.col("least") / F.sqrt("n2"), F.lit(float("-inf")))
    need = borders(queries.where(ratio > float("-inf")), ratio, [i / n_groups for i in range(1, n_groups)])
    group = F.size(F.filter(need, lambda b: b < ratio))
    tied = F.size(F.filter(need, lambda b: b == ratio))
    grouped = queries.withColumn("query_group", (group + F.pmod(spread, tied + 1)).cast("int"))
    left = grouped.withColumn("range", F.explode(to)).withColumn(
        "block", F.explode(F.sequence(F.col("range") * parts, F.col("range") * parts + parts - 1))).drop("range")
    wanted = left.select(F.col("block").alias("to"), F.col("query_group").alias("asking")).distinct()
    right = blocks.join(wanted, F.col("block") == F.col("to")).select("vec_id", "v", F.col("to").alias("block"), F.col("asking").alias("query_group"))

    def meet(key, qs, cs):
        out = pa.schema([("query_id", pa.int64()), ("qv", pa.list_(pa.int64())), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not qs.num_rows or not cs.num_rows:
            return out.empty_table()
        block = Block(cs.column("vec_id").to_numpy(), _matrix(cs.column("v"), dim), rotation, head)
        qid = qs.column("vec_id").to_numpy()
        least = np.nan_to_num(qs.column("least").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        found = block.search(qid, _matrix(qs.column("v"), dim), least, k)
        sizes = [len(s) for s, _ in found]
        at = np.repeat(np.arange(len(qid)), sizes)
        return pa.Table.from_arrays([
            pa.array(qid[at]), qs.column("v").combine_chunks().take(pa.array(at)),
            pa.array(np.concatenate([d for _, d in found]) if len(at) else np.zeros(0, np.int64)),
            pa.array(np.concatenate([s for s, _ in found]) if len(at) else np.zeros(0, np.int64)),
        ], schema=out)

    met = left.groupBy("block", "query_group").cogroup(right.groupBy("block", "query_group")).applyInArrow(
        meet, "query_id long, qv array<bigint>, vec_id long, score long")
    order = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20
"""
