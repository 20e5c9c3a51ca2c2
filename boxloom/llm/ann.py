"""Nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. It is posted under its first
`posted` pivots; a query opens the files of its first `opened` pivots. Inside a file the postings
are ranked by footrule distance between the two orders, and the best of them are ranked again by
the exact cosine. A row that is posted under several opened pivots is only ranked under the one
that comes first in the order of the query.

Files are split into pieces of bounded size, and the queries of a file into blocks, so a pivot
that is near to a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import arrow, stored

PIVOTS, DEPTH = 128, 64  # pivots, and how many of them an order holds
POSTED, OPENED = 8, 16
PIECE, BLOCK = 4096, 512  # postings and queries that meet in one task
RERANK = 256  # postings of a piece that are ranked by the exact measure for each query
FIT_ROWS = 2000  # rows from which the pivots are drawn


def _usable(vec: str):
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosine of one vector with every row, in double precision; the same rows give the same value."""
    return (_units(many) * _units(one[None, :])).sum(axis=1)


def _orders(rows: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    return np.argsort(-(_units(rows) @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.int16)


def fit_pivots(vectors: DataFrame, key: str, vec: str, pivots: int = PIVOTS, sample: int = FIT_ROWS) -> np.ndarray:
    """Unit vectors of `pivots` distinct rows out of the `sample` rows with the smallest hash."""
    rows = vectors.select(F.xxhash64(key, vec).alias("h"), vec).orderBy("h", vec).limit(sample).collect()
    if not rows:
        return np.zeros((0, 1))
    distinct = list({tuple(r[vec]): None for r in rows})
    return _units(np.array(distinct[:pivots], np.float64))


def _search(queries: pa.Table, posts: pa.Table, pivots: int, posted: int, rerank: int, top: int) -> pa.Table:
    """Best rows of one piece for every query of one block."""
    order = np.stack(posts["perm"].to_numpy()).astype(np.int64)
    ids, vectors = posts["id"].to_numpy(), np.stack(posts["vec"].to_numpy()).astype(np.float64)
    mine = np.stack(queries["perm"].to_numpy()).astype(np.int64)
    q_ids, q_vectors = queries["id"].to_numpy(), np.stack(queries["vec"].to_numpy()).astype(np.float64)
    depth = order.shape[1]
    places = np.arange(depth)
    pivot = int(posts["pivot"][0].as_py())
    out_q, out_id, out_score = [], [], []
    filed = order[:, :posted]
    for q in range(len(q_ids)):
        where = np.full(pivots, depth, np.int64)
        where[mine[q]] = places
        # an earlier opened pivot of the query that the row is posted under has the row already
        first = where[filed].min(axis=1) == where[pivot]
        take = np.flatnonzero(first & (ids != q_ids[q]))
        if not len(take):
            continue
        at = where[order[take]]
        footrule = np.abs(at - places).sum(axis=1) + at.sum(axis=1)  # up to what is equal for all rows
        if len(take) > rerank:
            cut = np.partition(footrule, rerank - 1)[rerank - 1]
            sure, tie = take[footrule < cut], take[footrule == cut]
            take = np.concatenate([sure, tie[np.argsort(ids[tie], kind="stable")[:rerank - len(sure)]]])
        score = cosines(q_vectors[q], vectors[take])
        best = np.lexsort((ids[take], -score))[:top]
        out_q.append(np.full(len(best), q_ids[q]))
        out_id.append(ids[take][best])
        out_score.append(score[best])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"query_id": pa.array(cat(out_q, np.int64)), "vec_id": pa.array(cat(out_id, np.int64)), "score": pa.array(cat(out_score, np.float64))})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vec: str = "embedding",
            pivots: int = PIVOTS, depth: int = DEPTH, posted: int = POSTED, opened: int = OPENED, rerank: int = RERANK,
            piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows found for every query, by cosine.

    Rows whose vector is null, zero, empty or holds a null or non-finite component take no part,
    neither does a row of another length than most have (of lengths as frequent, the smallest). A query is not its own neighbour; ties go
    to the smaller key. Repeated rows count once. A query for which the files held fewer than `k`
    rows is searched against all rows, in blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.where(_usable(vec)).select(F.col(key).alias("id"), F.col(vec).alias("vec")).where("id is not null")
    asked = queries.where(_usable(vec)).select(F.col(key).alias("id"), F.col(vec).alias("vec")).where("id is not null")
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    width = lengths["n"] if lengths else 0
    rows, asked = rows.where(F.size("vec") == width), asked.where(F.size("vec") == width)
    chosen = fit_pivots(rows, "id", "vec", pivots)
    size = len(chosen)
    schema = "query_id bigint, vec_id bigint, score double"
    if not size:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    deep = min(depth, size)
    shared = spark.sparkContext.broadcast(chosen)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                perm = _orders(_matrix(batch.column(1)), shared.value, deep)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, perm.size + 1, deep), pa.int32()), pa.array(perm.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["id", "vec", "perm"])

    def index(df: DataFrame) -> DataFrame:
        kind = df.schema["id"].dataType.simpleString()
        return arrow(df, ordered, f"id {kind}, vec {df.schema['vec'].dataType.simpleString()}, perm array<smallint>")

    ranked = stored(index(rows), "orders")
    found_queries = stored(index(asked), "queries")
    posts = ranked.select("id", "vec", "perm", F.explode(F.slice("perm", 1, posted)).alias("pivot"))
    files = posts.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows")).collect()  # a row per pivot
    pieces = {int(r["pivot"]): -(-int(r["rows"]) // piece) for r in files}
    asks = found_queries.select("id", "vec", "perm", F.explode(F.slice("perm", 1, opened)).alias("pivot"))
    loads = {int(r["pivot"]): -(-int(r["rows"]) // block) for r in asks.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows")).collect()}
    n_pieces = F.element_at(F.array(*[F.lit(pieces.get(p, 1)) for p in range(size)]), F.col("pivot") + 1)
    n_blocks = F.element_at(F.array(*[F.lit(loads.get(p, 1)) for p in range(size)]), F.col("pivot") + 1)
    everything = lambda n: F.sequence(F.lit(0), n - 1)
    posts = posts.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), n_pieces).cast("int")).withColumn("block", F.explode(everything(n_blocks)))
    asks = asks.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), n_blocks).cast("int")).withColumn("piece", F.explode(everything(n_pieces)))
    group = ("pivot", "piece", "block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _search(left, right, size, posted, rerank, k)

    found = asks.groupBy(*group).cogroup(posts.groupBy(*group)).applyInArrow(meet, schema)
    found = stored(found.distinct(), "found")
    served = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    rest = found_queries.join(served, found_queries["id"] == served["query_id"], "left_anti").select("id", "vec")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.union(_exhaustive(rest, ranked.select("id", "vec"), k, block)).distinct()
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _exhaustive(queries: DataFrame, rows: DataFrame, k: int, block: int) -> DataFrame:
    """Every query against all rows: blocks of queries meet every partition-sized piece of the rows."""
    schema = "query_id bigint, vec_id bigint, score double"
    asked = queries.agg(F.count(F.lit(1))).first()[0]
    if not asked:
        return queries.sparkSession.createDataFrame([], schema)
    blocks = max(1, -(-int(asked) // block))
    pieces = max(1, -(-int(rows.count()) // PIECE))
    q = queries.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("p"))
    r = rows.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("b"), F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("p"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, vectors = right["id"].to_numpy(), np.stack(right["vec"].to_numpy()).astype(np.float64)
            for q_id, q_vec in zip(left["id"].to_pylist(), left["vec"].to_pylist()):
                take = np.flatnonzero(ids != q_id)
                score = cosines(np.array(q_vec), vectors[take])
                for i in np.lexsort((ids[take], -score))[:k] if len(take) else []:
                    out["query_id"].append(q_id)
                    out["vec_id"].append(int(ids[take][i]))
                    out["score"].append(float(score[i]))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return q.groupBy("b", "p").cogroup(r.groupBy("b", "p")).applyInArrow(meet, schema)
