"""Near-duplicate vectors by spherical-cap filters.

Vectors of one label and dimension are compared by cosine in double precision. A filter is a direction from a random
product code: after a random rotation, the dimensions fall into ``m`` blocks, each with ``b`` random unit vectors, and
each choice of one vector for each block is a direction. A vector passes the filters on whose caps it lies, those with
an inner product of at least a bound; they are found by list decoding, which extends partial choices block by block
while the best rest could still reach the bound. Each vector has its own bound, the inner product of the last of its
best filters, so that none is left without. Vectors that pass the same filter are verified against one another.

A vector passes ``hits`` filters, as many in each of ``CODES`` independent codes, and their number follows the size of
its label, so that a filter has about ``CROWD`` vectors at any size. Labels of at most ``EXACT`` vectors, for which
comparing all is no dearer, have one filter that all pass: there no link is missed. A pair is counted at the
smallest filter that both pass. Filters that many vectors pass are cut into blocks by hash and each two blocks are a
task's run, so that no run has more than about 2 * ``BLOCK`` vectors; a run returns a row for each of its vectors at
most, never pairs. Equal vectors are verified as one and counted as many.

Defined cases: null ids, null labels, null, empty or zero vectors and vectors with null or non-finite components have
no links; rows that repeat an id are vectors of their own that are one vertex; vectors of different dimension have no
links; finite components of any size count, as vectors are scaled by their largest before their norm is taken; further
columns are ignored; an empty table gives no rows. Vectors are told apart by 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import arrow, components, few, runs, stored
from weftarc.llm.jaccard import local_components

HITS, CODES, CROWD, BLOCK = 16, 2, 64, 512
EXACT = 2048  # vectors of a label that are compared each with each
SLICE = 4096  # filters of a product


class Code:
    """Filters for vectors of one dimension."""

    def __init__(self, dimension: int, filters: int, hits: int = HITS, seed: int = 7):
        rng = np.random.default_rng(seed + dimension)
        self.m = max(1, min(dimension, max(2, math.ceil(math.log2(max(filters, 2)) / 7))))
        self.b = max(2, math.ceil(filters ** (1 / self.m)))
        self.rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.blocks = np.array_split(np.arange(dimension), self.m)
        self.words = []
        for block in self.blocks:
            w = rng.normal(size=(self.b, len(block)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(self.m))
        share = min(0.5, hits / self.b**self.m)
        self.bound = NormalDist().inv_cdf(1 - share) / math.sqrt(dimension)

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.rotation
        return [turned[:, block] @ w.T for block, w in zip(self.blocks, self.words)]

    def bounds(self, unit: np.ndarray, hits: int) -> np.ndarray:
        """For each unit vector, the bound that its best ``hits`` filters reach."""
        top = np.zeros((len(unit), 1))
        for s in self.scores(unit):
            s = -np.partition(-s, hits - 1, axis=1)[:, :hits] if s.shape[1] > hits else s
            # a sum among the best has a part among the best, whatever follows
            top = (top[:, :, None] + s[:, None, :]).reshape(len(unit), -1)
            top = -np.partition(-top, hits - 1, axis=1)[:, :hits] if top.shape[1] > hits else top
        return top.min(axis=1)

    def decode(self, unit: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and filters of all caps on which the unit vectors lie; bounds: their own, if not one for all."""
        scores = self.scores(unit)
        bound = np.full(len(unit), self.bound) if bounds is None else bounds - 1e-12
        best = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]  # of the blocks from here on
        row, code, sum_ = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, s in enumerate(scores):
            rest = best[k + 1][row] if k + 1 < self.m else 0.0
            total = sum_[:, None] + s[row]
            at, word = np.nonzero(total >= (bound[row] - rest)[:, None])
            row, code, sum_ = row[at], code[at] * self.b + word, total[at, word]
        return row, code


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first scaled by their largest component, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes(unit: np.ndarray, vectors: int, hits: int, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows and filters of unit vectors of a label of so many vectors. codes: keeps those made before."""
    if vectors <= EXACT:
        return np.arange(len(unit)), np.zeros(len(unit), np.int64)
    d, each = unit.shape[1], max(1, hits // CODES)
    filters = 1 << max(2, math.ceil(math.log2(vectors * each / CROWD)))  # few sizes, so that few codes are made
    rows, found = [], []
    for k in range(CODES):
        if (d, filters, k) not in codes:
            codes[d, filters, k] = Code(d, filters, each, 7 + 1_000_003 * k)
        code = codes[d, filters, k]
        row, at = code.decode(unit, code.bounds(unit, each))
        rows.append(row)
        found.append(at * CODES + k)
    return np.concatenate(rows), np.concatenate(found)


def _hits(batches: Iterator[pa.RecordBatch], hits: int) -> Iterator[pa.RecordBatch]:
    codes: dict = {}
    for b in batches:
        for start in range(0, b.num_rows, 2048):
            part = b.slice(start, 2048)
            dims, sizes = np.asarray(part.column("dim")), np.asarray(part.column("vectors"))
            for d, size in np.unique(np.stack([dims, sizes]), axis=1).T.tolist():
                at = np.flatnonzero((dims == d) & (sizes == size))
                own = part.take(pa.array(at))
                x = np.asarray(own.column("embedding").flatten()).reshape(-1, d).astype(np.float64)
                row, code = passes(units(x), size, hits, codes)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                ends = np.searchsorted(row, np.arange(len(at) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("node"), own.column("label"), own.column("dim"), pa.ListArray.from_arrays(pa.array(ends), pa.array(code))], ["node", "label", "dim", "filters"])


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["key"]):
        if t.num_rows < 2:
            continue
        nodes, times = np.array(t.column("node").to_pylist(), object), np.asarray(t.column("times"))
        order = np.argsort(nodes, kind="stable")
        nodes, times = nodes[order], times[order]
        blocks, filter_ = np.asarray(t.column("block"))[order], t.column("filter")[0].as_py()
        x = np.asarray(t.column("embedding").combine_chunks().flatten()).reshape(len(nodes), -1).astype(np.float64)[order]
        x = units(x)
        near = x @ x.T >= least
        if blocks.min() != blocks.max():  # within a block, its own run looks
            near &= blocks[:, None] != blocks[None, :]
        np.fill_diagonal(near, False)
        if not near.any():
            continue
        lists = t.column("filters").combine_chunks()
        sizes, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
        row = np.argsort(order)[np.repeat(np.arange(len(nodes)), sizes)]
        before = flat < filter_
        _, column, count = np.unique(flat[before], return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[before][shared], np.unique(column[shared], return_inverse=True)[1]
        order_ = np.argsort(column, kind="stable")
        row, column = row[order_], column[order_]
        earlier = np.zeros(near.shape, bool)  # pairs that meet at a smaller filter
        starts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1, SLICE))
        for a, z in zip(starts, [*starts[1:], len(column)]):
            passed = np.zeros((len(nodes), SLICE), np.float32)
            passed[row[a:z], column[a:z] % SLICE] = 1
            earlier |= passed @ passed.T > 0
        first = near & ~earlier
        label = local_components(near)
        some = near.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.binary()), pa.array(nodes[label[some]], pa.binary()), pa.array((first @ times)[some])], ["node", "hub", "links"])


def _identity() -> Column:
    """16 bytes for each label and vector."""
    h = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    return F.unhex(F.concat(h("label", "embedding"), h(F.lit(1), "label", "embedding", F.lit(2))))


def join(vectors: DataFrame, least: float = 0.98, hits: int = HITS) -> DataFrame:
    """vectors (vec_id, embedding, label) as (vec_id, n_links, component_id, kept)."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    good &= F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    usable = vectors.filter(F.coalesce(good, F.lit(False)))
    grouped = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    # one id may stand with several vectors, so a vertex of the verification is a vector, numbered by its hash
    distinct = stored(grouped.withColumn("key", _identity()).withColumn("dim", F.size("embedding")), "vectors")
    sizes = distinct.groupBy("label", "dim").agg(F.count("*").alias("vectors"))
    sized = distinct.join(few(sizes), ["label", "dim"]).select(F.col("key").alias("node"), "label", "dim", "vectors", "embedding")

    passed = stored(arrow(_hits, sized, f"node binary, label {dict(vectors.dtypes)['label']}, dim int, filters array<long>", hits), "filters")
    rows = passed.select("node", "label", "dim", F.explode("filters").alias("filter"))
    crowds = rows.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = rows.join(crowds.drop("n"), ["label", "dim", "filter"]).withColumn("block", F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("key", F.concat_ws("/", "label", "dim", "filter", F.least("block", "with"), F.greatest("block", "with"))).select("key", "node", "filter", "block")
    whole = distinct.select(F.col("key").alias("node"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), "times").join(passed.select("node", "filters"), "node")
    found = arrow(_verify, dealt.join(whole, "node").repartition(F.col("key")).sortWithinPartitions("key"), "node binary, hub binary, links long", least)
    found = stored(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))

    # back to ids: each vector row with its vector's key, links of that and of its copies
    own = usable.select("vec_id", _identity().alias("key"))
    counted = own.join(distinct.select("key", "times", F.col("node").alias("head")), "key").join(links.withColumnRenamed("node", "key"), "key", "left")
    counted = stored(counted.select("vec_id", "key", "head", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "counted")
    copies = counted.filter("n_links > 0").select(F.col("vec_id").alias("node"), F.col("key").alias("hub"))
    hubs = found.select(F.col("node").alias("key"), F.col("hub").alias("other")).distinct()
    across = counted.select("key", F.col("head").alias("node")).distinct().join(hubs, "key").select("node", F.col("other").alias("hub"))
    labels = components(copies.unionByName(across)).withColumnRenamed("node", "vec_id")
    rest = vectors.filter(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    every = counted.select("vec_id", "n_links").unionByName(rest)
    result = every.join(labels, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive e as materialized (select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) as v from embeddings),
n as materialized (select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from e where len(v) > 0 and label is not null),
l as materialized (select a.vec_id as x, b.vec_id as y from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r(x, y) as (select vec_id, vec_id from e union select r.x, l.y from r join l on r.y = l.x),
c as (select x, min(y) as component_id from r group by x), k as (select x, count(*) as n from l group by x)
select e.vec_id, coalesce(k.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept from e join c on c.x = e.vec_id left join k on k.x = e.vec_id
"""
