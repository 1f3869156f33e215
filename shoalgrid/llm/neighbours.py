"""Approximate nearest neighbours by balanced posting lists, a graph over their centroids, and pruning by distance ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.llm.store import single_value, written

#: Rows that a fit reads at most, and lists at most: what the driver and every task hold is bounded by them.
SAMPLE, MAX_LISTS = 65_536, 4_096
#: Vectors aimed at in a list, and centroids a boundary vector may be filed under.
LIST_ROWS, REPLICAS = 256, 4
#: A vector is filed under further centroids up to this times its distance to the nearest.
BOUNDARY = 1.1
#: Links of a centroid in the graph, and how many candidates a search keeps.
LINKS, BEAM = 16, 12
#: Part of the sample's true neighbours that the ratio for pruning lists must reach; a neighbour of the whole table is nearer and is found more often.
TARGET, TRIALS = 0.96, 512
#: Vectors and queries that meet in one group: larger lists are cut, queries of a list dealt.
GROUP_VECTORS, GROUP_QUERIES = 4_096, 2_048


def _distances(x, c):
    """Squared distances of rows of ``x`` to rows of ``c``."""
    import numpy as np

    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None], 0)


def _balanced(x, most: int, seed: int = 0) -> list:
    """Row numbers of ``x`` by leaf of a tree of 2-means splits at the median, until leaves have ``most`` rows at most; near leaves are near in the list."""
    import numpy as np

    leaves, todo = [], [np.arange(len(x))]
    random = np.random.default_rng(seed)
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        two = x[random.choice(rows, 2, replace=False)].astype(np.float64)
        for _ in range(6):
            near = _distances(x[rows], two).argmin(1)
            two = np.stack([x[rows[near == k]].mean(0) if (near == k).any() else two[k] for k in (0, 1)])
        order = np.argsort(x[rows] @ (two[1] - two[0]), kind="stable")
        half = len(rows) // 2
        todo += [rows[order[half:]], rows[order[:half]]]
    return leaves


class Index:
    """Centroids in the order of the tree, a graph of near and a few random links between them, and the ratio for pruning."""

    def __init__(self, x, n: int, scale: float):
        import numpy as np

        self.scale = scale  # the largest norm: one more component lifts every vector to it
        lists = min(MAX_LISTS, max(1, math.ceil(n / LIST_ROWS)), max(1, len(x) // 8))
        leaves = _balanced(x, max(1, math.ceil(len(x) / lists))) if len(x) else []
        self.centroids = np.stack([x[r].mean(0) for r in leaves]) if leaves else np.zeros((0, x.shape[1]))
        for _ in range(4):  # means of what is nearest, the balanced leaves to begin with
            if len(self.centroids) > 1:
                near = np.concatenate([_distances(x[k : k + 4096], self.centroids).argmin(1) for k in range(0, len(x), 4096)])
                held = np.bincount(near, minlength=len(self.centroids))
                sums = np.zeros_like(self.centroids)
                np.add.at(sums, near, x)
                self.centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], self.centroids)
        self._link()
        self.ratio = 1.0
        self._calibrate(x)

    def _link(self) -> None:
        import numpy as np

        c, k = self.centroids, len(self.centroids)
        links = min(LINKS, max(k - 1, 0))
        near = np.zeros((k, links), dtype=np.int64)
        for at in range(0, k, 512):
            d = _distances(c[at : at + 512], c)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 512] = np.argsort(d, 1, kind="stable")[:, :links]
        # A ring and three jumps along the tree's order make the graph connected with short ways.
        far = [(np.arange(k) + step) % max(k, 1) for step in (1, -1, k // 2, k // 4, k // 8)]
        self.graph = np.concatenate([near, np.stack(far, 1)], 1) if k else near

    def nearest(self, q, beam: int = BEAM):
        """(numbers, squared distances) of near centroids of each row, the nearest first, by a best-first search of the graph from spread entries, all rows at once."""
        import numpy as np

        k, rows = len(self.centroids), np.arange(len(q))[:, None]
        norms = (self.centroids * self.centroids).sum(1)
        own = (q * q).sum(1)[:, None]

        def away(ids):
            return np.maximum(own + norms[ids] - 2 * np.einsum("bd,bkd->bk", q, self.centroids[ids]), 0)

        beam = min(beam, k)
        entries = np.unique(np.linspace(0, k - 1, beam).astype(np.int64))
        ids = np.broadcast_to(entries, (len(q), len(entries))).copy()
        seen = np.zeros((len(q), k), dtype=bool)
        seen[:, entries] = True
        d, open_ = away(ids), np.ones(ids.shape, dtype=bool)
        while open_.any():
            best = np.where(open_, d, np.inf).argmin(1)[:, None]
            open_[rows, best] = False
            more = self.graph[ids[rows, best][:, 0]]
            new = ~seen[rows, more]
            seen[rows, more] = True
            ids, d = np.concatenate([ids, more], 1), np.concatenate([d, np.where(new, away(more), np.inf)], 1)
            open_ = np.concatenate([open_, new], 1)
            order = np.argsort(d, 1, kind="stable")[:, :beam]
            ids, d, open_ = ids[rows, order], d[rows, order], open_[rows, order] & np.isfinite(d[rows, order])
            # A link that a row meets twice in one step has a second place; it is closed here.
            twice = (ids[:, 1:] == ids[:, :-1]) & (d[:, 1:] == d[:, :-1])
            open_[:, 1:] &= ~twice
        return ids, d

    def within(self, q, ratio: float):
        """A mask (rows, lists): centroids up to ``ratio`` times as far as the nearest that links lead to, each from one already inside."""
        import numpy as np

        inside = np.zeros((len(q), len(self.centroids)), dtype=bool)
        if not len(self.centroids):
            return inside
        ids, d = self.nearest(q)
        limit = d[:, 0] * ratio * ratio * (1 + 1e-9) + 1e-12
        rows, cols = np.nonzero(d <= limit[:, None])
        seen = np.zeros_like(inside)
        at = ids[rows, cols]
        seen[rows, at] = inside[rows, at] = True
        norms, own = (self.centroids * self.centroids).sum(1), (q * q).sum(1)
        while len(rows):
            more = np.unique((rows[:, None] * inside.shape[1] + self.graph[at]).ravel())
            rows, at = more // inside.shape[1], more % inside.shape[1]
            new = ~seen[rows, at]
            rows, at = rows[new], at[new]
            seen[rows, at] = True
            near = own[rows] + norms[at] - 2 * np.einsum("nd,nd->n", q[rows], self.centroids[at]) <= limit[rows]
            rows, at = rows[near], at[near]
            inside[rows, at] = True
        return inside

    def filed(self, x):
        """A mask (rows, REPLICAS) and list numbers: the nearest centroid and, for boundary vectors, others about as near in other directions."""
        import numpy as np

        ids, d = self.nearest(x)
        ids, d = ids[:, : 2 * REPLICAS], d[:, : 2 * REPLICAS]
        take = np.zeros(ids.shape, dtype=bool)
        take[:, 0] = True
        for k in range(1, ids.shape[1]):
            near = (d[:, k] <= d[:, 0] * BOUNDARY * BOUNDARY) & (ids[:, :k] != ids[:, k : k + 1]).all(1) & (take.sum(1) < REPLICAS)
            apart = ((self.centroids[ids[:, :k]] - self.centroids[ids[:, k]][:, None]) ** 2).sum(2)
            take[:, k] = near & (~take[:, :k] | (apart > d[:, k : k + 1])).all(1)
        return ids, take

    def _calibrate(self, x) -> None:
        """The smallest ratio, in steps, at which lists hold TARGET of the true neighbours of rows of the sample in the sample; all lists where none does."""
        import numpy as np

        if len(self.centroids) < 2:
            return
        tests = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(np.int64)
        true = np.concatenate([np.argsort(_distances(x[tests[k : k + 64]], x), 1)[:, 1:21] for k in range(0, len(tests), 64)])
        filed = [self.filed(x[k : k + 2048]) for k in range(0, len(x), 2048)]
        ids, take = (np.concatenate([f[k] for f in filed]) for k in (0, 1))
        for ratio in (*np.arange(1.0, 2.0, 0.02), *np.arange(2.0, 10.0, 0.25), np.inf):
            self.ratio = float(ratio)
            inside = self.within(x[tests], self.ratio)
            hit = inside[np.arange(len(tests))[:, None, None], ids[true]] & take[true]
            if hit.any(2).mean() >= TARGET:
                return

    def lift(self, v, query: bool = False):
        """Rows with one more component, so that the nearest by distance has the largest inner product: norms become ``scale``; a query is scaled to it."""
        import numpy as np

        norms = np.sqrt((v * v).sum(1))
        if query:
            return np.concatenate([v * (self.scale / np.maximum(norms, 1e-300))[:, None], np.zeros((len(v), 1))], 1)
        return np.concatenate([v, np.sqrt(np.maximum(self.scale**2 - norms**2, 0))[:, None]], 1)


def _matrix(column):
    """Rows of equal length of an Arrow list column as doubles."""
    import numpy as np

    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _valid(table: DataFrame, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of doubles that take part, shorter ones with zeros at the end."""
    v = F.col(vector_col).cast("array<double>")
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id"), v.alias("v")).filter(F.coalesce(whole, F.lit(False)))
    longest = single_value(rows, F.coalesce(F.max(F.size("v")), F.lit(0)))[0]
    padded = F.when(F.size("v") == longest, F.col("v")).otherwise(F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))
    return rows.select("vec_id", padded.alias("v"))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids, nameless): each vector once with its ``keep`` smallest ids, and whether a row without id is among them; no more of equal vectors can be among a query's nearest."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("rank", rank).filter(F.col("rank") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.bool_or(F.col("vec_id").isNull()).alias("nameless"))


def fit(distinct: DataFrame) -> Index:
    """An Index from a sample of SAMPLE rows at most, chosen by hash; of all rows the number and the largest norm."""
    import numpy as np

    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, largest = single_value(distinct, F.count("*"), F.max(square))
    part = min(1.0, 0.9 * SAMPLE / max(n, 1))
    some = distinct.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1) if part < 1 else distinct
    found = some.select("v").limit(SAMPLE).toArrow().column("v").combine_chunks()
    v = _matrix(found) if len(found) else np.zeros((0, 0))
    index = Index.__new__(Index)
    index.scale = math.sqrt(largest or 1.0)
    index.__init__(index.lift(v), n, index.scale)
    return index


def search(table: DataFrame, k: int = 20, every: int = 20, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its ``k`` nearest found among all other rows.

    Nearness is the inner product in double precision; ties go to the smaller id. Equal vectors are one entry of the
    lists with their smallest ids, so copies cost nothing and lose nothing. Lists are of balanced size by the
    sample; a vector at a boundary is in several; lists of more vectors or queries than a group takes are cut and
    dealt. A query goes to every list whose centroid is up to a ratio times as far as the nearest one; the ratio is
    the least that finds TARGET of the neighbours in the sample, up to all lists where vectors have no structure.

    Vectors that are null, empty, zero, or hold nulls or non-finite components take no part; shorter vectors count as
    followed by zeros; a row without id is no query, and is returned, after all others of its score, with a null id; rows
    of one id are not neighbours of each other; equal rows count once; no rows give none.
    """
    import numpy as np

    spark = table.sparkSession
    rows = _valid(table.withColumnRenamed(id_col, "vec_id") if id_col != "vec_id" else table, vector_col)
    distinct = written(_distinct(rows, k + 2), "vectors")
    index = fit(distinct)
    shared = spark.sparkContext.broadcast(index)  # MAX_LISTS centroids with their links

    def file(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, take = index.filed(index.lift(_matrix(part.column(0))))
                row, col = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col]), *(c.take(pa.array(row)) for c in part.columns)], names=["list", "v", "ids", "nameless"])

    postings = written(distinct.mapInArrow(file, "list long, v array<double>, ids array<long>, nameless boolean"), "postings")
    held = dict(postings.groupBy("list").count().collect())  # MAX_LISTS rows at most
    # Neighbours in the tree's order share a group while they fit; a larger list is cut.
    group, groups, cuts = np.zeros(len(index.centroids) + 1, dtype=np.int64), 0, []
    room = 0
    for c in range(len(index.centroids)):
        size = held.get(c, 0)
        if not cuts or size > room:
            groups, room = groups + 1, GROUP_VECTORS
            cuts.append(max(1, math.ceil(size / GROUP_VECTORS)))
        group[c], room = groups - 1, room - size
    cuts = np.array(cuts, dtype=np.int64)

    def route(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, lists = np.nonzero(index.within(index.lift(_matrix(part.column(1)), query=True), index.ratio))
                key = row * len(cuts) + group[lists]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
                ends = np.append(first, len(key)).astype(np.int32)
                probed = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists.astype(np.int64)))
                who = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), pa.array(group[lists[first]]), probed, part.column(1).take(who)], names=["query_id", "grp", "lists", "q"])

    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    routed = written(queries.mapInArrow(route, "query_id long, grp long, lists array<long>, q array<double>"), "routed")
    asked = dict(routed.groupBy("grp").count().collect())  # a row a group, MAX_LISTS at most
    deals = np.array([max(1, math.ceil(asked.get(g, 0) / GROUP_QUERIES)) for g in range(len(cuts))], dtype=np.int64)
    sizes = spark.createDataFrame([(int(c), int(group[c]), int(cuts[group[c]]), int(deals[group[c]])) for c in range(len(index.centroids))], "list long, grp long, cuts long, deals long")
    steps = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = postings.join(F.broadcast(sizes), "list").select("list", "v", "ids", "nameless", "grp", "deals", F.pmod(F.xxhash64("v"), F.col("cuts")).alias("cut"))
    a = a.select("list", "v", "ids", "nameless", "grp", "cut", steps("deals").alias("deal"))
    per_group = F.broadcast(sizes.select("grp", "cuts", "deals").distinct())
    b = routed.join(per_group, "grp").select("query_id", "grp", "lists", "q", "cuts", F.pmod(F.xxhash64("query_id", "q"), F.col("deals")).alias("deal"))
    b = b.select("query_id", "grp", "lists", "q", steps("cuts").alias("cut"), "deal")

    def meet(vectors, asked):
        import pandas as pd

        empty = pd.DataFrame({"query_id": [], "qh": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "qh": "int64", "vec_id": "Int64", "score": "float64"})
        if not len(vectors) or not len(asked):
            return empty
        v = np.stack(vectors["v"].to_numpy())
        names = [[(False, int(x)) for x in ids] + [(True, 0)] * none for ids, none in zip(vectors["ids"], vectors["nameless"])]
        single = np.array([len(x) == 1 and not x[0][0] for x in names])
        first = np.array([x[0][1] for x in names], dtype=np.int64)
        of_list = {c: np.flatnonzero(vectors["list"].to_numpy() == c) for c in vectors["list"].unique()}
        out = []
        for qid, qh, q, lists in zip(asked["query_id"], asked["qh"], asked["q"], asked["lists"]):
            members = [of_list[c] for c in lists if c in of_list]
            if not members:
                continue
            rows = np.concatenate(members)
            near = v[rows] @ q
            near[single[rows] & (first[rows] == qid)] = -np.inf
            if len(rows) > 2 * k:
                # A margin of rounding about the k-th keeps ties; scores are summed anew, in one order for every vector.
                cut = np.partition(near, len(near) - 2 * k)[len(near) - 2 * k]
                rows = rows[near >= cut - 1e-9 * (abs(cut) + 1)]
            rows = np.unique(rows[~(single[rows] & (first[rows] == qid))])
            score = (v[rows] * q).sum(1)
            ids = {(-s, *x) for r, s in zip(rows, score) for x in names[r] if x != (False, qid)}
            out += [(qid, qh, None if none else x, -s) for s, none, x in sorted(ids)[:k]]
        return pd.DataFrame(out, columns=["query_id", "qh", "vec_id", "score"]).astype({"query_id": "int64", "qh": "int64", "vec_id": "Int64", "score": "float64"}) if out else empty

    keys = ["grp", "cut", "deal"]
    b = b.withColumn("qh", F.xxhash64("q"))
    found = a.groupBy(keys).cogroup(b.groupBy(keys)).applyInPandas(lambda x, y: meet(x, y), "query_id long, qh long, vec_id long, score double")
    order = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    return ranked.dropDuplicates(["query_id", "qh", "rank"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
