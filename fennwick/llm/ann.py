"""Nearest neighbours by inverted lists with an adaptive dimension scan.

Vectors are rotated at random, so that a few columns tell much about the whole. Rows are dealt to lists: the cells of a
k-means fitted on a bounded sample, each cut again by a second k-means of what the first leaves over (one set of
centres for all cells, so that the number of lists grows with the table while the sample and the centres stay bounded). A
query probes the lists that promise the largest products. Within a list candidates are read by blocks of columns: the
distance seen so far, scaled to all columns, estimates the whole, and a candidate is abandoned when a hypothesis test
says that it can't reach the worst of the best k found (Gao and Long's test, at ``epsilon``). How many lists are probed
is chosen on the sample, for a recall of ``TARGET`` there: few for clustered vectors, where work grows as the queries; a
share of all lists for noise, where it grows as queries times rows, as it must for any exact enough search. Survivors are
scored exactly, in double precision, on the original vectors.

Lists are cut into blocks of bounded size (so a list with a third of all rows is many tasks) and so are the queries
that probe one; a task holds one block of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fennwick.llm.common import bound_batches, materialize, table

K = 20
SAMPLE_ROWS = 20_000
#: Lists for so many rows each; so many centres at most in either k-means.
LIST_ROWS = 800
MAX_CENTRES = 1024
#: Recall on the sample for which the number of probed lists is chosen.
TARGET = 0.96
#: One in so many of the probed lists is searched first, to get a floor for the others.
FIRST_SHARE = 6
EPSILON = 2.1
COLUMN_BLOCK = 16
BLOCK_ROWS = 4096
#: Queries of a task, and of one step within it. A row is copied once for each task of queries that probe its list.
QUERY_ROWS = 4096
STEP_QUERIES = 256


def _clean(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: no null, zero or non-finite vectors, and the first dimension met most."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast(kind).alias("v")).where(F.col("vec_id").isNotNull()).where(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().collect()  # a row for each dimension
    if not sizes:
        return rows.where(F.lit(False))
    d = max(sizes, key=lambda r: (r["count"], -r["d"]))["d"]
    return rows.where(F.size("v") == d)


def rotation(d: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of distinct sample vectors; empty centres keep their place."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def scan(query: np.ndarray, rotated: np.ndarray, rows: np.ndarray, seen: np.ndarray, reach: np.ndarray, first: int, epsilon: float = EPSILON, block: int = COLUMN_BLOCK) -> np.ndarray:
    """The rows that the tests from column ``first`` on leave, given the squared distances seen before it.

    ``reach`` is the squared distance |q|^2 + |x|^2 - 2 floor at which a row's inner product is the floor.
    """
    d = rotated.shape[1]
    for at in range(first, d, block):
        if not len(rows):
            break
        part = rotated[rows, at : at + block] - query[at : at + block]
        seen = seen + (part * part).sum(1)
        done = min(at + block, d)
        stay = seen * (d / done) <= reach * _slack(done, d, epsilon) + 1e-12
        rows, seen, reach = rows[stay], seen[stay], reach[stay]
    return rows


def _slack(done: int, d: int, epsilon: float) -> float:
    return (1 + epsilon / np.sqrt(done)) ** 2 if done < d else 1 + 1e-9


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each from its own row alone: equal vectors get equal scores in blocks of any size.

    A matrix product would not do: it sums in another order for other shapes.
    """
    return (rows * query).sum(axis=1)


def search_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int = K, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of each query's best k rows of a block at or above its floor, ties to the smaller vec_id.

    The first column block is read for all queries at once; what its test leaves is scanned query by query.
    """
    rotated = x @ turn
    parts = [_search_step(*(y[at : at + STEP_QUERIES] for y in (q_ids, q, floors)), ids, x, rotated, turn, k, epsilon) for at in range(0, len(q_ids), STEP_QUERIES)]
    return tuple(map(np.concatenate, zip(*parts)))


def _search_step(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, rotated: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rq = q @ turn
    d = x.shape[1]
    first = min(COLUMN_BLOCK, d)
    head, q_head = rotated[:, :first], rq[:, :first]
    seen = np.maximum((q_head * q_head).sum(1)[:, None] + (head * head).sum(1) - 2 * (q_head @ head.T), 0)
    reach = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * np.maximum(floors, -1e300)[:, None], 0)
    stay = seen * (d / first) <= reach * _slack(first, d, epsilon) + 1e-12
    stay &= ids != q_ids[:, None]
    out_q, out_v, out_s = [], [], []
    for i in range(len(q_ids)):
        rows = np.flatnonzero(stay[i])
        if np.isfinite(floors[i]):
            rows = scan(rq[i], rotated, rows, seen[i, rows], reach[i, rows], first, epsilon)
        s = products(x[rows], q[i])
        rows, s = rows[s >= floors[i]], s[s >= floors[i]]
        top = _top(s, ids[rows], k)
        out_q.append(np.full(len(top), q_ids[i]))
        out_v.append(ids[rows[top]])
        out_s.append(s[top])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


class Lists:
    """Cells of two k-means: a vector's list is its nearest first centre and the second centre nearest to the rest."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.width, self.probes = 1, 1  # first centres that a query looks at, and lists that it probes there

    def __len__(self) -> int:
        return len(self.first) * len(self.second)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of each row."""
        a = _nearest(x, self.first)
        return a * len(self.second) + _nearest(x - self.first[a], self.second)

    def best(self, q: np.ndarray, width: int, most: int) -> np.ndarray:
        """For each query the ``most`` lists of the ``width`` best first centres, by the products of their centres."""
        coarse, fine = q @ self.first.T, q @ self.second.T
        out = np.empty((len(q), min(most, width * len(self.second))), dtype=np.int64)
        for i in range(len(q)):
            near = np.argsort(-coarse[i], kind="stable")[:width]
            sums = (coarse[i, near, None] + fine[i]).ravel()
            lists = (near[:, None] * len(self.second) + np.arange(len(self.second))).ravel()
            out[i] = lists[np.argsort(-sums, kind="stable")[: out.shape[1]]]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def fit_lists(sample: np.ndarray, rows: int, k: int, list_rows: int = LIST_ROWS, target: float = TARGET, queries: int = 256) -> Lists:
    """Lists for a table of so many rows, and the fewest probes for a recall of ``target`` among the sample's own rows.

    Recall is measured by brute force on the sample: first centres enough for the square root of the target, then
    lists among theirs for the rest.
    """
    wanted, bound = max(1, rows // list_rows), max(1, min(MAX_CENTRES, len(sample) // 8))
    first = kmeans(sample, min(wanted, bound))
    rest = sample - first[_nearest(sample, first)]
    more = min(bound, -(-wanted // len(first)))
    lists = Lists(first, kmeans(rest, more) if more > 1 else np.zeros((1, sample.shape[1])))
    q = np.random.default_rng(7).choice(len(sample), min(queries, len(sample)), replace=False)
    near = sample[q] @ sample.T
    near[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    if not best.size:
        lists.width, lists.probes = len(first), len(lists)
        return lists
    at = lists.of(sample)

    def share(order: np.ndarray, held: np.ndarray, part: float) -> int:
        places = np.sort([np.append(np.flatnonzero(o == h), order.shape[1])[0] for o, hs in zip(order, held) for h in hs])
        return min(order.shape[1], int(places[min(len(places) - 1, int(np.ceil(part * len(places))) - 1)]) + 1)

    two = len(lists.second) > 1
    coarse = np.argsort(-(sample[q] @ first.T), axis=1, kind="stable")
    lists.width = share(coarse, at[best] // len(lists.second), np.sqrt(target) if two else target)
    lists.probes = share(lists.best(sample[q], lists.width, len(lists)), at[best], target) if two else lists.width
    return lists


def nearest(vectors: DataFrame, query_every: int = 20, k: int = K, id_col: str = "vec_id", column: str = "embedding", sample_rows: int = SAMPLE_ROWS, epsilon: float = EPSILON, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_every``, against all other rows.

    The nearest lists are searched first; their k-th score is the floor from which the other probed lists are scanned, so
    they return few rows. Rows without id, and vectors that are null, zero, of an odd dimension or hold null or
    non-finite components, take no part. A repeated query id asks once, by its smallest vector; repeated candidates
    count as rows. Fewer rows than k give all; an empty table gives none.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = _clean(vectors, id_col, column)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / n) * (1 << 30)))).select("v").limit(2 * sample_rows).collect()
    sample = np.array([r["v"] for r in picked] or [rows.first()["v"]], dtype=np.float64)
    turn, index = rotation(sample.shape[1]), fit_lists(sample, n, k, list_rows)
    shared = spark.sparkContext.broadcast((index, turn))  # 2 * MAX_CENTRES centres at most
    stack = lambda v: np.stack(v.to_list()).astype(np.float64)

    @F.pandas_udf("long")
    def list_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value[0].of(stack(v)) if len(v) else [], dtype="int64")

    @F.pandas_udf("array<long>")
    def probes_of(v: pd.Series) -> pd.Series:
        lists = shared.value[0]
        return pd.Series(lists.best(stack(v), lists.width, lists.probes).tolist() if len(v) else [])

    queries = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    dealt = materialize(rows.select("vec_id", "v", list_of("v").alias("list")), "ann-lists")
    asking = materialize(queries.withColumn("probes", probes_of("v")), "ann-queries")
    held = materialize(dealt.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("r")), "ann-sizes")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, v, s = search_block(b["vec_id"].to_numpy(), stack(b["v"]), b["floor"].to_numpy(), a["vec_id"].to_numpy(), stack(a["v"]), shared.value[1], k, epsilon)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    def search(asked: DataFrame) -> DataFrame:
        """What each query (vec_id, v, floor) finds in the list it names, a block of either side in each task."""
        asks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("q"))
        many = materialize(held.join(asks, "list"), "ann-blocks")  # a row for each list that is asked
        spread = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(11)), n).cast("int")
        left = dealt.join(many, "list").select("list", spread(F.col("r")).alias("rb"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("qb"), "vec_id", "v")
        right = asked.join(many, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("rb"), spread(F.col("q")).alias("qb"), "vec_id", "v", "floor")
        keys = ["list", "rb", "qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    low = F.lit(float("-inf"))
    near = -(-index.probes // FIRST_SHARE)
    first = materialize(best(search(asking.select("vec_id", "v", F.explode(F.slice("probes", 1, near)).alias("list"), low.alias("floor")))), "ann-first")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(low).alias("floor"))
    others = asking.join(floors, asking["vec_id"] == floors["query_id"], "left").select("vec_id", "v", F.explode(F.slice("probes", near + 1, len(index))).alias("list"), F.coalesce("floor", low).alias("floor"))
    return best(first.drop("rank").unionByName(search(others)))


def op8_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th vector, by inner product."""
    return nearest(table(spark, sf_dir, "embeddings"))
