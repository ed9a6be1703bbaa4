"""Approximate nearest neighbours by cosine: coarse centroids, product-quantised residuals, asymmetric distance tables, exact reranking."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import written

#: Vectors that the index is fitted on, about and at most; all vectors are indexed.
TRAIN_ROWS = 20_000
#: Lists grow as the square root of the table, up to one for so many fitted vectors.
ROWS_A_LIST = 40
#: Share of the neighbours of fitted vectors, among the fitted ones, that the probed lists hold: few lists do where
#: vectors form clusters, most are needed where they are unstructured.
PROBED_SHARE = 0.99
PARTS = 16
CODES = 256
#: Candidates of each query that are reranked exactly, at least.  All others whose estimate is within so many of its
#: standard errors of the k-th best estimate are reranked too: in tight clusters codes don't tell rows apart.
RERANK = 128
ERRORS = 3.0
#: Queries and coded vectors that meet in one place, at most about.
QUERY_ROWS = 50_000
SLAB_ROWS = 1_000_000
SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """Centroids of x; k is cut to the number of distinct rows.  Empty clusters take the farthest points."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], minlength=k) / np.maximum(n, 1), c[:, j])
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(1)), kind="stable")[: len(empty)]
            c[empty[: len(far)]] = x[far]
    return c


class Index:
    """What is fitted: coarse centroids and the codebooks of the residuals' parts, and how many lists to probe."""

    def __init__(self, x: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES, probes: int | None = None, seed: int = SEED):
        self.dim = x.shape[1]
        self.coarse = kmeans(x, lists, seed=seed)
        rest = x - self.coarse[self.nearest(x)]
        self.cuts = np.linspace(0, self.dim, min(parts, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], codes, seed=seed + 1 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.probes = min(probes or self.needed(x), len(self.coarse))

    def needed(self, x: np.ndarray, queries: int = 500, k: int = 5, share: float = PROBED_SHARE) -> int:
        """Lists to probe so that they hold that share of the k nearest other rows of some of x's rows."""
        some = np.random.default_rng(SEED).permutation(len(x))[:queries]
        if len(x) <= k:
            return len(self.coarse)
        like = x[some] @ x.T
        like[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-like, k, 1)[:, :k]
        place = np.empty((len(some), len(self.coarse)), np.int64)
        np.put_along_axis(place, self.order(x[some]), np.arange(len(self.coarse))[None], 1)
        return int(np.quantile(np.take_along_axis(place, self.nearest(x)[near], 1), share)) + 1

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.coarse * self.coarse).sum(1) - 2 * x @ self.coarse.T).argmin(1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists, nearest first."""
        return np.argsort((self.coarse * self.coarse).sum(1) - 2 * q @ self.coarse.T, 1, kind="stable")

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.nearest(x)
        rest = x - self.coarse[near]
        code = np.empty((len(x), len(self.books)), np.uint8)
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            code[:, j] = ((self.books[j] ** 2).sum(1) - 2 * rest[:, a:b] @ self.books[j].T).argmin(1)
        return near, code

    def estimates(self, x: np.ndarray, near: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors x and what their codes stand for, y: 1 / (x * y), which makes of q * y an unbiased estimate of q * x, and that estimate's error.

        The error is the tangent of the angle between x and y, times ERRORS / sqrt(dim - 1) (1 at most, where it is a bound).
        """
        y = self.coarse[near] + np.concatenate([book[code[:, j]] for j, book in enumerate(self.books)], 1)
        dot = (x * y).sum(1)
        cosine = np.clip(dot / np.maximum(np.sqrt((y * y).sum(1)), 1e-300), 1e-3, 1.0)
        error = np.sqrt(1 - cosine**2) / cosine * min(1.0, ERRORS / max(self.dim - 1, 1) ** 0.5)
        # a code that doesn't point its vector's way says nothing: such rows are always reranked
        lost = dot < 1e-3
        return np.where(lost, 0.0, 1 / np.where(lost, 1.0, dot)), np.where(lost, np.inf, error + 1e-6)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Asymmetric tables of queries: for every part [queries, codes], query * codebook row."""
        return [(q[:, a:b] @ book.T).astype(np.float32) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, coarse=self.coarse, cuts=self.cuts, probes=self.probes, **{f"b{j}": b for j, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Index:
        self, z = cls.__new__(cls), np.load(io.BytesIO(raw))
        self.coarse, self.cuts, self.probes = z["coarse"], z["cuts"], int(z["probes"])
        self.dim, self.books = self.coarse.shape[1], [z[f"b{j}"] for j in range(len(self.cuts) - 1)]
        return self


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def prepared(batches):
    """Of rows (key, vec_id, v, is_query) those with a finite vector that isn't zero, with norm and dim.

    Vectors are multiplied by a power of two that brings their largest component
    near 1: exact, and sums of squares neither overflow nor vanish.
    """
    for b in batches:
        v = b.column(2)
        dims = np.array([-1 if n is None else n for n in pa.compute.list_value_length(v).to_pylist()])
        for dim in np.unique(dims[dims > 0]):
            at = np.flatnonzero(dims == dim)
            x = v.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy().reshape(-1, dim)
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[fine], x[fine]
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
            part = b.take(pa.array(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, part.column(3), pa.array(np.sqrt((x * x).sum(1))), pa.array(np.full(len(x), dim), pa.int32())], names=["key", "vec_id", "v", "is_query", "norm", "dim"])


def best_coded(index: Index, keys: np.ndarray, ids: np.ndarray, lists: np.ndarray, code: np.ndarray, scale: np.ndarray, error: np.ndarray, who: np.ndarray, q: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, coded row, estimated cosine): of the coded vectors of each query's probed lists the rerank best by tables, and all that may be among the k best.

    Equal estimates go to the smaller id; a query's own key takes no part.
    """
    order = np.lexsort((ids, lists))
    keys, ids, lists, code, scale, error = keys[order], ids[order], lists[order], code[order], scale[order].astype(np.float32), error[order].astype(np.float32)
    first = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    spans = list(zip(lists[first], first, np.r_[first[1:], len(lists)], strict=True))
    columns = [np.ascontiguousarray(code[:, j]) for j in range(code.shape[1])]
    out = []
    step = max(1, 4_000_000 // len(ids))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        probed = np.zeros((len(part), len(index.coarse)), bool)
        np.put_along_axis(probed, index.order(part)[:, : index.probes], True, 1)
        tables = index.tables(part)
        base = (part @ index.coarse.T).astype(np.float32)
        near = np.full((len(part), len(ids)), -np.inf, np.float32)
        for list_, a, b in spans:
            mine = np.flatnonzero(probed[:, list_])
            if len(mine):
                total = np.repeat(base[mine, list_][:, None], b - a, 1)
                for table, column in zip(tables, columns, strict=True):
                    total += table[mine][:, column[a:b]]
                near[mine, a:b] = total * scale[None, a:b]
        near[who[at : at + step, None] == keys[None]] = -np.inf
        for i, row in enumerate(near):
            best = np.flatnonzero(row > -np.inf)
            if len(best) > rerank:
                kth, limit = -np.partition(-row, (k - 1, rerank - 1))[[k - 1, rerank - 1]]
                maybe = row + error >= kth
                maybe &= row > -np.inf
                above, equal = np.flatnonzero((row > limit) | maybe), np.flatnonzero((row == limit) & ~maybe)
                room = max(0, rerank - len(above))
                best = np.r_[above, equal[np.argsort(ids[equal], kind="stable")[:room]]]
            out.append((np.full(len(best), who[at + i]), order[best], row[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, queries: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, probes: int | None = None, rerank: int = RERANK, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The k nearest rows by cosine, the query's own row excepted, for every row for which `queries` holds.

    Returns query_id, rank (from 1), vec_id, score (cosine of the original
    vectors in double precision), ties to the smaller vec_id.  Vectors that are
    null, empty or zero or that hold a null or non-finite component take no
    part, nor do null ids.  Vectors are compared with those of their own length;
    each length has its own index.  Rows with repeated ids are rows of their
    own, as queries (their answers then share a query_id) and as candidates.
    Fewer candidates give fewer rows; empty tables give empty results.  Other
    columns are ignored.  An index is fitted on at most train_rows vectors and
    is all that is broadcast; all vectors are indexed, of equal ones the k + 1
    with the smallest ids, as no other copy can be among the k nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = written(rows.mapInArrow(prepared, "key long, vec_id long, v array<double>, is_query boolean, norm double, dim int"), "vectors")
    copy = Window.partitionBy("dim", "v").orderBy("vec_id", "key")
    offered = written(rows.withColumn("copy", F.row_number().over(copy)).where(F.col("copy") <= k + 1).drop("copy"), "offered")
    asking = {r.dim: r.n for r in rows.where("is_query").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    found = None
    for dim, total in offered.groupBy("dim").agg(F.count("*")).orderBy("dim").collect():
        asked = asking.get(dim, 0)
        if asked and total > 1:
            here = F.col("dim") == dim
            mine = _search_length(offered.where(here), rows.where(here & F.col("is_query")), dim, total, asked, k, lists, probes, max(rerank, k), train_rows)
            found = mine if found is None else found.unionByName(mine)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _units(rows: DataFrame, dim: int) -> np.ndarray:
    """The vectors of a bounded number of rows at the driver, of length 1."""
    table = rows.select("v", "norm").toArrow()
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim) / table.column("norm").to_numpy()[:, None]


def _search_length(rows: DataFrame, queries: DataFrame, dim: int, total: int, asked: int, k: int, lists: int | None, probes: int | None, rerank: int, train_rows: int) -> DataFrame:
    spark = rows.sparkSession
    # a threshold on the hash first, so that no partition sends more than its share to the driver
    place = F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED)), F.lit(1 << 30))
    sample = rows.where(place < int(min(1.0, 1.1 * train_rows / total) * (1 << 30))).orderBy(place, "v").limit(train_rows)
    x = _units(sample, dim)
    if not len(x):
        x = _units(rows.orderBy("vec_id", "v").limit(1), dim)
    index = spark.sparkContext.broadcast(Index(x, lists or max(1, min(int(total**0.5), len(x) // ROWS_A_LIST)), probes=probes).pack())
    slabs = -(-total // SLAB_ROWS)
    # as many groups of queries as keep their number bounded, and at least enough to give all cores work
    groups = max(-(-asked // QUERY_ROWS), min(-(-asked // 64), -(-2 * spark.sparkContext.defaultParallelism // slabs)))

    def code(batches):
        fitted = Index.unpack(index.value)
        for b in batches:
            x = _matrix(b.column(2), dim) / b.column(3).to_numpy()[:, None]
            near, c = fitted.encode(x)
            scale, error = fitted.estimates(x, near, c)
            packed = pa.Array.from_buffers(pa.binary(c.shape[1]), len(c), [None, pa.py_buffer(np.ascontiguousarray(c))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), packed, pa.array(scale), pa.array(error)], names=["key", "vec_id", "list", "code", "scale", "error"])

    coded = written(rows.select("key", "vec_id", "v", "norm").mapInArrow(code, "key long, vec_id long, list int, code binary, scale double, error double"), "codes")
    unit = F.transform("v", lambda x: (x / F.col("norm")).cast("float"))
    asking = queries.select(F.col("key").alias("query"), unit.alias("q"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))
    placed = coded.withColumn("slab", F.pmod(F.xxhash64("key"), F.lit(slabs)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def score(left, right):
        who, keys, ids, at, near, error = *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.float32), np.zeros(0)
        if left.num_rows and right.num_rows:
            fitted = Index.unpack(index.value)
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            q = left.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            keys, ids, scale, error = (right.column(c).to_numpy() for c in ("key", "vec_id", "scale", "error"))
            who, at, near = best_coded(fitted, keys, ids, right.column("list").to_numpy(), codes, scale, error, left.column("query").to_numpy(), q, k, rerank)
        return pa.table({"query": pa.array(who), "key": pa.array(keys[at]), "vec_id": pa.array(ids[at]), "near": pa.array(near), "error": pa.array(error[at])})

    both = ["grp", "slab"]
    found = asking.groupBy(*both).cogroup(placed.groupBy(*both)).applyInArrow(score, "query long, key long, vec_id long, near float, error double")
    best = Window.partitionBy("query").orderBy(F.desc("near"), "vec_id", "key")
    ranked = found.withColumn("r", F.row_number().over(best)).withColumn("kth", F.max(F.when(F.col("r") == k, F.col("near"))).over(Window.partitionBy("query")))
    short = ranked.where((F.col("r") <= rerank) | (F.col("near") + F.col("error") >= F.col("kth"))).select("query", "key")
    one = queries.select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("norm").alias("qn"))
    pairs = short.join(rows.select("key", "vec_id", "v", "norm"), "key").join(one, "query")
    dot = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = pairs.select("query", "query_id", "vec_id", (dot / (F.col("norm") * F.col("qn"))).alias("score"), "key")
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "key")
    return exact.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
