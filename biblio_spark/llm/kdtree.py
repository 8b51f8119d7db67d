"""Exact top-k by inner product over KD-trees, one for each shard of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.storage import materialize, release

#: Vectors of one leaf.
LEAF = 256
#: Least and most vectors of one shard and queries of one block; in between, about so many shards or blocks are made.
SHARD, MOST_SHARD, SHARDS = 4096, 32_768, 64
BLOCK, MOST_BLOCK, BLOCKS = 1024, 8192, 16
#: Vectors at most from which the driver takes the splits that part the space into at most 2 ** DEPTH cells.
SAMPLE, DEPTH = 4096, 6

_LEAST = -(2**62)


class KDTree:
    """Median splits of integer vectors along the widest side down to leaves, in whose order ids and vectors stand. Nodes are numbered from
    the root, 0, on: ``low`` and ``high`` are their tight bounding boxes, ``left`` and ``right`` their children (-1 of a leaf), ``first``
    and ``last`` the rows of a leaf; ``starts`` where the leaves begin, in their order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        parts: list[np.ndarray] = []
        nodes: list[list] = []
        self._split(vectors, np.argsort(ids, kind="stable"), leaf, parts, nodes)
        order = np.concatenate(parts)
        self.ids, self.vectors = ids[order], vectors[order]
        self.starts = np.cumsum([0, *map(len, parts)])
        self.low, self.high = np.stack([n[0] for n in nodes]), np.stack([n[1] for n in nodes])
        self.left, self.right, self.first, self.last = (np.array([n[k] for n in nodes], dtype=np.int64) for k in (2, 3, 4, 5))

    def _split(self, vectors: np.ndarray, rows: np.ndarray, leaf: int, parts: list, nodes: list) -> int:
        own = vectors[rows]
        node = [own.min(axis=0), own.max(axis=0), -1, -1, 0, 0]
        number = len(nodes)
        nodes.append(node)
        if len(rows) > leaf and vectors.shape[1]:
            width = node[1].astype(np.int64) - node[0]
            side = int(np.argmax(width))
            if width[side] > 0:
                middle = len(rows) // 2
                order = np.argpartition(own[:, side], middle, kind="introselect")
                node[2] = self._split(vectors, np.sort(rows[order[:middle]]), leaf, parts, nodes)
                node[3] = self._split(vectors, np.sort(rows[order[middle:]]), leaf, parts, nodes)
                return number
        node[4] = sum(map(len, parts))
        node[5] = node[4] + len(rows)
        parts.append(rows)
        return number

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, ids, scores): for each query its ``k`` best among the vectors of this tree, or what of them reaches
        ``floor``, a kth score known from elsewhere. ``own`` are the ids of the queries, which do not find themselves.

        The bound of a box is the largest inner product any point in it can have. Each query has a queue of open nodes, the root at first. It
        takes the one with the best bound: of an inner node both children come in with their own, tighter bounds, of a leaf
        the vectors are compared. It ends when its best bound is below its kth score so far. Queries that take the same node do so together.
        """
        exact = _exact(self.vectors, queries)
        vectors, queries = self.vectors.astype(exact), queries.astype(exact)
        low, high = self.low.astype(exact), self.high.astype(exact)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        none = np.finfo(exact).min if exact is np.float64 else np.iinfo(exact).min
        queue = np.full((len(queries), len(self.left)), none, dtype=exact)
        queue[:, 0] = plus @ high[0] + minus @ low[0]
        worst = floor.astype(exact)
        q, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, exact)
        active = np.arange(len(queries))
        self.visited = 0
        while len(active):
            node = queue[active].argmax(axis=1)
            best = queue[active, node]
            go = (best >= worst[active]) & (best > none)
            active, node = active[go], node[go]
            queue[active, node] = none
            found = []
            order = np.argsort(node, kind="stable")
            by_node = active[order]
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            for some, at in zip(np.split(by_node, cuts), node[order][np.concatenate([[0], cuts])] if len(order) else (), strict=False):
                if self.left[at] >= 0:
                    for child in (self.left[at], self.right[at]):
                        queue[some, child] = plus[some] @ high[child] + minus[some] @ low[child]
                    continue
                self.visited += len(some)
                a, b = self.first[at], self.last[at]
                product = queries[some] @ vectors[a:b].T
                row, column = np.nonzero(product >= worst[some][:, None])
                others = self.ids[a:b][column]
                keep = others != own[some][row]
                found.append((some[row][keep], others[keep], product[row, column][keep]))
            if not found:
                continue
            q, ids, scores = (np.concatenate([x, *parts]) for x, parts in zip((q, ids, scores), zip(*found, strict=True), strict=True))
            best = np.lexsort((ids, -scores, q))
            q, ids, scores = q[best], ids[best], scores[best]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            full = rank == k - 1
            worst[q[full]] = np.maximum(worst[q[full]], scores[full])
            q, ids, scores = q[rank < k], ids[rank < k], scores[rank < k]
        return q, ids, scores.astype(np.int64)


def _exact(*arrays: np.ndarray) -> type:
    """float64 where every inner product and bound is an exact integer there, else int64."""
    largest = max(float(np.abs(a.astype(np.float64)).max(initial=0)) for a in arrays)
    return np.float64 if largest**2 * max(arrays[0].shape[1], 1) < 2**52 else np.int64


def quantized(vectors: DataFrame, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, x as double. Rows with a null id, a null vector or a null or
    non-finite component are left out."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & finite).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")
    )


def _cells(rows: DataFrame, depth: int) -> Column:
    """The number of a vector's cell: median splits along the widest side of a sample, for the commonest dimension."""
    sample = [r["v"] for r in rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    sizes = [len(v) for v in sample]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d), default=0)
    some = [v for v in sample if len(v) == dim]
    points = np.array(some, dtype=np.int64).reshape(len(some), dim)

    def split(some: np.ndarray, levels: int, number: int) -> Column:
        if levels == 0 or len(some) < 64 or not dim:
            return F.lit(number)
        side = int(np.argmax(np.quantile(some, 0.95, axis=0) - np.quantile(some, 0.05, axis=0)))
        middle = int(np.median(some[:, side]))
        left = some[:, side] <= middle
        if left.all() or not left.any():
            return F.lit(number)
        low, high = split(some[left], levels - 1, 2 * number), split(some[~left], levels - 1, 2 * number + 1)
        return F.when(F.get("v", F.lit(side)) <= middle, low).otherwise(high)

    return F.when(F.col("dim") == dim, split(points, depth, 1)).otherwise(F.lit(0))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of one dimension and cell in groups of about ``size``: dim, ``name``, rows, and the least and greatest components."""
    counts = {f"{r['dim']}:{r['cell']}": max(1, -(-r["n"] // size)) for r in rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    groups = F.lit(1)
    if counts:
        groups = F.element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), F.concat_ws(":", "dim", "cell"))
    # the row's place in the written table spreads repeated rows as well
    number = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), groups)
    grouped = rows.withColumn(name, F.concat_ws(":", "cell", number)).groupBy("dim", name)
    return grouped.agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))


def _arrays(rows: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of one list of (vec_id, v), the vectors in the least integer type that holds them."""
    ids, vectors = rows.values.flatten()
    matrix = vectors.flatten().to_numpy().reshape(len(ids), dim)
    for kind in (np.int8, np.int16, np.int32):
        if len(matrix) and dim and np.iinfo(kind).min <= matrix.min() and matrix.max() <= np.iinfo(kind).max:
            matrix = matrix.astype(kind)
            break
    return ids.to_numpy(), matrix


def _stored(tree: KDTree) -> bytes:
    import pickle

    return pickle.dumps(tree, protocol=5)


def _loaded(content: bytes) -> KDTree:
    import pickle

    return pickle.loads(content)


_BOX = "low array<long>, high array<long>"


def _built(groups: DataFrame, name: str, tree: bool) -> DataFrame:
    """dim, ``name``, the box of all vectors and, for shards, the tree, else ids and vectors as they are."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim = batch.column("dim")[k].as_py()
                ids, vectors = _arrays(batch.column("rows")[k], dim)
                content = _stored(KDTree(ids, vectors)) if tree else _stored((ids, vectors))
                box = [pa.array([x.astype(np.int64).tolist()], type=pa.list_(pa.int64())) for x in (vectors.min(axis=0), vectors.max(axis=0))]
                columns = [batch.column("dim").slice(k, 1), batch.column(name).slice(k, 1), *box, pa.array([content], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", name, "low", "high", "content"])

    return groups.mapInArrow(build, f"dim int, {name} string, {_BOX}, content binary")


def _bound() -> Column:
    """The largest inner product that a query of a block's box (a, b) can have with a vector of a shard's box (low, high)."""
    sides = F.arrays_zip("a", "b", "low", "high")
    most = lambda s: F.greatest(*(s[x] * s[y] for x in ("a", "b") for y in ("low", "high")))
    return F.aggregate(sides, F.lit(0).cast("long"), lambda total, s: total + most(s))


_FOUND = "query_id long, vec_id long, score long"


def _visited(pairs: DataFrame, k: int) -> DataFrame:
    """(dim, block, asked, floors, content) to the best of every shard for every query of its block."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                tree = _loaded(batch.column("content")[n].as_py())
                own, queries = _loaded(batch.column("asked")[n].as_py())
                floor = np.full(len(own), _LEAST, dtype=np.int64)
                known = batch.column("floors")[n]
                if known.is_valid and len(known):
                    ids, kth = (x.to_numpy() for x in known.values.flatten())
                    floor[np.searchsorted(own, ids)] = kth
                q, others, scores = tree.search(own, queries, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(others), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return pairs.select("asked", "floors", "content").mapInArrow(visit, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, shard: int | None = None, block: int | None = None, rounds: int = 3) -> DataFrame:
    """The ``k`` best other vectors of every vector for which ``queries`` holds: query_id, rank, vec_id, score.

    ``vectors`` is what ``quantized`` returns; other columns are left aside. Ties go to the smaller vec_id. Vectors meet only
    those of their own dimension. Of repeated vec_ids all rows are candidates, except for a query with that id, which is
    answered once, for its least vector; very many equal vectors spread over shards. Fewer candidates give fewer rows, an empty
    table none.

    Splits of a sample part the space into cells, cells into hashed shards; each shard's tree is built once and written. Queries
    lie in blocks of one cell. In ``rounds``, a block visits its shards by falling bounds of the boxes: one, then a fourth of
    them, then the rest. After each round the kth scores so far go along, and pairs of block and shard whose boxes
    cannot reach the least of them are left out before any vector moves. Only the k best of a shard leave it. Vectors without
    structure leave no pair out: then all queries meet all vectors, in matrix products.
    """
    spark = vectors.sparkSession
    rows = materialize(vectors.select("vec_id", "v", F.size("v").alias("dim")), "vectors")
    n = rows.count()
    shard = shard or min(max(SHARD, n // SHARDS), MOST_SHARD)
    depth = min(DEPTH, max(0, (n // shard).bit_length() - 1))
    cell = _cells(rows, depth)
    asked = rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("r")).select("vec_id", "r.dim", "r.v")
    asked = materialize(asked.withColumn("cell", cell), "asked")
    block = block or min(max(BLOCK, asked.count() // BLOCKS), MOST_BLOCK)
    shards = materialize(_built(_packed(rows.withColumn("cell", cell), shard, "shard"), "shard", True), "shards")
    blocks = materialize(_built(_packed(asked, block, "block"), "block", False), "blocks")
    release(rows, asked)

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    boxes = blocks.select("dim", "block", F.col("low").alias("a"), F.col("high").alias("b"))
    pairs = boxes.join(shards.select("dim", "shard", "low", "high"), "dim").select("dim", "block", "shard", _bound().alias("bound"))
    place = W.partitionBy("dim", "block").orderBy(F.desc("bound"), "shard")
    size = F.count("*").over(W.partitionBy("dim", "block"))
    turn = F.when(F.col("p") == 1, 0).when(F.col("p") <= 1 + size / 4, 1).otherwise(2) if rounds > 1 else F.lit(0)
    pairs = pairs.withColumn("p", F.row_number().over(place)).withColumn("turn", F.least(turn, F.lit(rounds - 1)))
    pairs = materialize(pairs.select("dim", "block", "shard", "bound", "turn"), "pairs")
    named = blocks.select("dim", "block", F.col("content").alias("asked"))
    best = None
    for r in range(rounds):
        now = pairs.where(F.col("turn") == r)
        if best is None:
            now = now.withColumn("floors", F.lit(None).cast("array<struct<query_id: long, kth: long>>"))
        else:
            floors = materialize(_floors(best, blocks, k), "floors")
            now = now.join(floors, ["dim", "block"], "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        moved = now.select("dim", "block", "shard", "floors").join(named, ["dim", "block"]).join(shards.select("dim", "shard", "content"), ["dim", "shard"])
        found = _visited(moved.repartition(partitions), k)
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        best = _best(found, k)
        if r < rounds - 1:
            best = materialize(best, "best")
    return best.select("query_id", "rank", "vec_id", "score")


def _floors(best: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(dim, block, floors, least): the kth scores of a block's queries that have k results; ``least`` over all its queries, null
    if one has fewer."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, _ = _loaded(batch.column("content")[n].as_py())
                one = lambda c: batch.column(c).take(pa.array(np.full(len(ids), n)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one("dim"), one("block"), pa.array(ids)], names=["dim", "block", "query_id"])

    of = blocks.select("dim", "block", "content").mapInArrow(listed, "dim int, block string, query_id long")
    kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rows = of.join(kth, "query_id", "left").groupBy("dim", "block")
    known = F.when(F.col("kth").isNotNull(), F.struct("query_id", "kth"))
    return rows.agg(F.collect_list(known).alias("floors"), F.when(F.count("kth") == F.count("*"), F.min("kth")).alias("least"))
