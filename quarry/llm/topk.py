"""Operator 12: exact top-k search by exhaustive term-at-a-time accumulation.

A component of a vector is a term, its whole number ``floor(256 * x)`` the weight; terms
of weight 0 aren't kept, so a query is a sparse row.  Candidates are dealt into blocks,
and each block holds its postings: of each term the candidates that have it, with their
weights.  Queries are dealt into blocks as well.  A cell is one block of either side: in
it each query's terms scatter their weighted postings into a dense array of scores, a
partition selection takes the best, and a window over the cells' best merges them.

Every query meets every candidate, so the work grows with both; the blocks bound what a
task holds, and only blocks are copied, each to the cells of its row or column.

Results: (query_id, rank, vec_id, score), the ``k`` highest scores of each query row
among all rows but its own, ties to the smaller vec_id.

Nulls and edge cases: vectors that are null, or hold null or non-finite components, take
no part; of vectors of several lengths the missing components count 0, so an empty
vector scores 0; a null vec_id is no query, and as a candidate it comes last among ties;
of rows of one vec_id each is a query and each a candidate of the others; tables without
queries or candidates give no rows; other columns are ignored.  Sums are exact whole
numbers; a weight or score that no 64-bit number holds is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import starts

K = 5
SCALE = 256
#: Rows of a block at most, and components of its vectors, give or take how evenly rows are dealt.
CANDIDATES = 1 << 16
QUERIES = 1 << 13
COMPONENTS = 1 << 23
BLOCK = "block int, ids binary, nulls binary, begin binary, other binary, weights binary"
#: The last id of all, for rows without one.
LAST = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def weights_of(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the weights that aren't 0."""
    n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and not np.abs(flat).max() < 2.0**62:
        raise OverflowError("a component's weight is beyond 64 bits")
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(row)) - np.repeat(starts(n)[:-1], n)
    some = np.flatnonzero(flat)
    return row[some], term[some], flat[some].astype(np.int64)


def blocks(vectors: DataFrame, number: int, by_term: bool) -> DataFrame:
    """One row for each block: ids in ascending order, and its weights by term (postings) or by row (queries)."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        ids, null = table["vec_id"].fill_null(LAST).to_numpy(), table["vec_id"].is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((null, ids))
        row, term, weight = weights_of(table["vector"].combine_chunks())
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row = place[row]
        key, other = (term, row) if by_term else (row, term)
        sort = np.lexsort((other, key))
        size = int(key.max(initial=-1)) + 1 if by_term else len(ids)
        begin = starts(np.bincount(key, minlength=size))
        parts = (ids[order], null[order], begin, other[sort].astype(np.int32), weight[sort])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["block", "ids", "nulls", "begin", "other", "weights"])

    return vectors.repartition(number).mapInArrow(run, BLOCK)


def accumulated(postings, n: int, terms: np.ndarray, weights: np.ndarray, kind) -> np.ndarray:
    """Scores of all candidates of a block for one query: each of its terms scatters its postings."""
    begin, rows, values = postings
    scores = np.zeros(n, kind)
    for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
        if t + 1 >= len(begin):
            continue
        a, b = begin[t], begin[t + 1]
        if b - a == n:  # all candidates have the term
            scores += values[a:b] * w
        else:
            scores[rows[a:b]] += values[a:b] * w
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, candidates_in_block: int = CANDIDATES, queries_in_block: int = QUERIES, components_in_block: int = COMPONENTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows (vec_id, vector); the rows of ``queries`` are rows of ``vectors``, each of which doesn't find itself."""
    spark = vectors.sparkSession
    vectors, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(usable(F.col("vector"))) for x in (vectors, queries))
    (n, size), (m, q_size) = (x.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first() for x in (vectors, queries))
    # A small table has blocks enough for all cores too.
    c_rows = min(candidates_in_block, max(1_024, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    c_blocks, q_blocks = (max(1, -(-x // rows), -(-y // components_in_block)) for x, rows, y in ((n, c_rows, size), (m, queries_in_block, q_size)))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            one = lambda t, name, kind: np.frombuffer(t[name][0].as_py(), kind)
            ids, nulls = one(left, "ids", np.int64), one(left, "nulls", bool)
            begin, rows, values = one(left, "begin", np.int64), one(left, "other", np.int32), one(left, "weights", np.int64)
            q_ids, q_begin, q_terms, q_weights = one(right, "ids", np.int64), one(right, "begin", np.int64), one(right, "other", np.int32), one(right, "weights", np.int64)
            most = int(np.abs(values).max(initial=0)) * int(np.abs(q_weights).max(initial=0)) * int(np.diff(q_begin).max(initial=0))
            own_most = int(np.abs(q_weights).max(initial=0)) ** 2 * int(np.diff(q_begin).max(initial=0))
            # Whole numbers as wide as the greatest sum that there can be; beyond 64 bits Python's own.
            kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
            postings = (begin, rows, values.astype(kind))
            for q, (a, b) in enumerate(zip(q_begin[:-1].tolist(), q_begin[1:].tolist(), strict=True)):
                terms, w = q_terms[a:b], q_weights[a:b]
                scores = accumulated(postings, len(ids), terms, w, kind)
                own = int(w @ w) if own_most < 2**63 else sum(x * x for x in w.tolist())
                at = best(scores, k + 1)
                out[0] += [key[1].as_py() << 32 | q] * len(at)
                out[1] += [int(q_ids[q])] * len(at)
                out[2] += [None if nulls[j] else int(ids[j]) for j in at]
                like = [bool(scores[j] == own) and not nulls[j] and ids[j] == q_ids[q] for j in at]
                # A vector's product with itself isn't in the result, so it alone may be beyond 64 bits.
                out[3] += [min(x, LAST) if y else x for x, y in zip(scores[at].tolist(), like, strict=True)]
                out[4] += like
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["row", "query_id", "vec_id", "score", "like_own"])

    left = blocks(vectors, c_blocks, True).select(F.col("block").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), *BLOCK.replace("block int, ", "").replace(" binary", "").split(", "))
    right = blocks(queries, q_blocks, False).select(F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"), F.col("block").alias("q"), "ids", "begin", "other", "weights")
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(run, "row long, query_id long, vec_id long, score long, like_own boolean")
    # A query's own row is among its k + 1 best if it matters; rows of one id and score are alike, so any of them can stand for it.
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    own = F.coalesce(F.min(F.when(F.col("like_own"), F.col("place"))).over(Window.partitionBy("row")), F.lit(k + 2))
    return ranked.withColumn("own", own).where(F.col("place") != F.col("own")).withColumn("rank", F.col("place") - (F.col("place") > F.col("own")).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
