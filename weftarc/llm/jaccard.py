"""Similarity join of documents on sets of word n-grams, by blocked sparse matrix products.

A document's set holds the distinct n-word shingles of its words, lower-cased in A-Z; with fewer words than n, the whole
sequence is one. Two documents link when the size of the intersection of their sets is at least ``num / den`` of that
of their union. The stages:

1. Every text is read once for the size and a 128-bit digest of its set and for counts of shingles in a table of
   ``CELLS`` cells, which each task passes on and which are summed; cells far above the mean hold common passages.
2. Every text is read again for its prefix: sets that link share one of their first s - ceil(s * num / den) + 1
   shingles in any common order. Here cells that stand out come last, and else long shingles, which are seldom common,
   come first, so that prefixes seldom meet by chance. A shingle in several prefixes puts its documents in the group of
   the smallest of them; groups are (document, smallest document) rows, and pairs are never made.
3. Documents with equal sets are represented by the smallest id. The representatives in a group form blocks by size and
   hash. Each has a sketch: one bit for about each shingle, the parity of how many shingles hash there. Two sketches
   differ in no more bits than the sets do in shingles, so pairs that differ in more bits than their sizes allow a link
   go, and no other does. What is left of a block pair goes on as its connected components.
4. Those components, joined over all groups, are small sets of near copies. Only for these are texts read a third time,
   and their sets sent to blocks. A task multiplies the incidence matrices of its rows over slices of the shingles that
   two rows share, accumulating overlaps and discarding pairs as soon as a bound from their sizes and what is left cannot
   be met. A component of one block is done then. In a larger one, each block has its own rows and the smallest document
   of all; only rows that this leaves outside of the largest cluster meet all other blocks in a second round. So the sets
   that move grow with the rows of a component of near copies of one document, not with their square.
5. Components over these links and equal sets are the result.

Shingles are compared by 64-bit hashes, which differ between different shingles of two documents but for about 1 in
10^13 of pairs of documents of 1,000 words.

Defined cases: null, empty or white texts have the size 0 and link with nothing; a null id has a null component and
links with nothing; rows that repeat an id are one vertex, each row keeping its own size; ties need no rule; further
columns are ignored; an empty table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import arrow, components, few, release, remove, runs, slices, stored

CELLS, CHUNK = 1 << 22, 1 << 12  # of the table of counts, and what is summed at once
ROWS, SHINGLES = 512, 250_000  # of a block of sets, at most about so many
SKETCHES, BITS = 2048, 1 << 26  # of a block of sketches
SLICE = 4096  # shingles of a product


class Hashes(dict):
    """64-bit hashes of words; they are kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(text: str | None, n: int, words: Hashes) -> tuple[np.ndarray, list[bytes], int]:
    """The shingle hashes of a text in order, its words, and how many of these are in a shingle."""
    if not text or not (split := text.encode().lower().split()):
        return np.empty(0, np.uint64), [], n
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    m = min(n, len(h))
    mixed = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += h[i : len(h) - m + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return mixed, split, m


def shingles(text: str | None, n: int, words: Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(_mixed(text, n, words)[0])


def cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _sizes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n_shingles, digest) for each document, then (chunk, cells) of the counts, 255 at most, of this task."""
    words, counts = Hashes(), np.zeros(CELLS, np.int32)
    names = ["doc_id", "n_shingles", "digest", "chunk", "cells"]
    for b in slices(batches, "text"):
        sizes, digests = [], []
        for t in b.column("text").to_pylist():
            s = shingles(t, n, words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            np.add.at(counts, cell(s), 1)
        k = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    if counts.any():
        cells = [c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8).reshape(-1, CHUNK)]
        k = len(cells)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(cells, pa.binary())], names)


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums (chunk, cells), as unsigned 32-bit numbers, of rows sorted by chunk, holding one chunk at a time."""
    last, total = None, np.zeros(CHUNK, np.uint32)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "cells"])

    for b in batches:
        for chunk, cells in zip(b.column("chunk").to_pylist(), b.column("cells")):
            if chunk != last:
                if last is not None:
                    yield row()
                last = chunk
                total[:] = 0
            total += np.frombuffer(cells.as_buffer(), np.uint8)
    if last is not None:
        yield row()


def levels(chunks: pa.Table) -> np.ndarray:
    """How far each cell stands out: 0 up to two deviations over the mean, then the bits of the excess.

    By chance one in forty is over that; as levels only order shingles, that does no harm.
    """
    rows = [(c.as_py(), np.frombuffer(x.as_buffer(), np.uint32)) for c, x in zip(chunks.column("chunk"), chunks.column("cells"))]
    mean = sum(int(x.sum(dtype=np.int64)) for _, x in rows) / CELLS
    out = np.zeros(CELLS, np.uint8)
    for c, x in rows:
        out[c * CHUNK : (c + 1) * CHUNK] = np.ceil(np.log2(np.maximum(0, x - mean - 2 * math.sqrt(mean)) + 1))
    return out


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-size * num // den) + 1


def width(size: int) -> int:
    """Bits of the sketch of a set: a power of two, at least 64 and the size."""
    return max(64, 1 << (size - 1).bit_length())


def sketch(s: np.ndarray) -> bytes:
    """For each bit, whether an odd number of shingles hashes there."""
    bits = width(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, table) -> Iterator[pa.RecordBatch]:
    """(node, size, shingles, sketch): the prefix in the common order, and the sketch of the whole set."""
    words, level = Hashes(), table.value
    for b in slices(batches, "text"):
        nodes, sizes, sketches, keys = [], [], [], []
        for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            mixed, split, m = _mixed(t, n, words)
            if doc is None or not len(mixed):
                continue
            s, at = np.unique(mixed, return_index=True)
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
            long_ = np.minimum(ends[at + m] - ends[at], 65535)
            order = np.argsort(level[cell(s)].astype(np.int64) << 16 | 65535 - long_, kind="stable")  # then by hash, as s is sorted
            keys.append(s[order[: prefix_length(len(s), num, den)]])
            nodes.append(doc)
            sizes.append(len(s))
            sketches.append(sketch(s))
        if nodes:
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(sketches, pa.binary())], ["node", "size", "shingles", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = Hashes()
    for b in slices(batches, "text", 1 << 22):
        sets = [shingles(t, n, words).tobytes() for t in b.column("text").to_pylist()]
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(sets, pa.binary())], [*rest, "set"])


def sizes_allow(sizes: np.ndarray, others: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sets of these sizes: the intersection that a link needs, and whether it can be."""
    # intersection x of sizes a, b links if den * x >= num * (a + b - x)
    need = -(-num * (sizes[:, None] + others[None, :]) // (num + den))
    return need, np.minimum.outer(sizes, others) >= np.maximum(need, 1)


def possible(sizes: np.ndarray, sketches: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs may link, as a matrix: those whose sketches differ in no more bits than their sets may in shingles."""
    out = np.zeros((len(sizes), len(sizes)), bool)
    words = np.array([len(x) for x in sketches])
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        own = np.stack([sketches[i] for i in at])
        for wider in np.unique(words[words >= w]):
            to = np.flatnonzero(words == wider)
            folded = np.stack([sketches[i] for i in to])
            while folded.shape[1] > w:  # the parity of two halves is that of both
                folded = folded[:, : folded.shape[1] // 2] ^ folded[:, folded.shape[1] // 2 :]
            step = max(1, (1 << 20) // (len(to) * int(w)))
            for i in range(0, len(at), step):
                rows = at[i : i + step]
                need, allowed = sizes_allow(sizes[rows], sizes[to], num, den)
                if allowed.any():
                    bits = np.bitwise_count(own[i : i + step, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
                    allowed &= bits <= sizes[rows][:, None] + sizes[to][None, :] - 2 * need
                    out[np.ix_(rows, to)] |= allowed
                    out[np.ix_(to, rows)] |= allowed.T
    np.fill_diagonal(out, False)
    return out


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs of sets link, as a matrix; by products of incidence matrices over slices of the shared shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    need, open_ = sizes_allow(sizes, sizes, num, den)
    np.fill_diagonal(open_, False)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    left = np.bincount(row, minlength=len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    overlap = np.zeros(need.shape, np.int64)
    starts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1, SLICE))
    for a, z in zip(starts, [*starts[1:], len(column)]):
        open_ = open_ & (overlap + np.minimum.outer(left, left) >= need)
        if not open_.any():
            return open_
        part = np.zeros((len(sets), SLICE), np.float32)
        part[row[a:z], column[a:z] % SLICE] = 1
        overlap += (part @ part.T).astype(np.int64)
        left = left - np.bincount(row[a:z], minlength=len(sets))
    return open_ & (overlap >= need)


def local_components(matrix: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest index of its component."""
    label = np.arange(len(matrix))
    for i in range(len(matrix)):
        if label[i] != i:
            continue
        reached = new = matrix[i].copy()
        reached[i] = True
        while new.any():
            further = matrix[new].any(axis=0) & ~reached
            reached, new = reached | further, further
        label[reached] = i
    return label


def _clusters(nodes: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(node, hub) of rows, sorted by node, that are in a component of two or more; the hub is its smallest node."""
    label = local_components(matrix)
    some = np.bincount(label, minlength=len(label))[label] > 1
    if some.any():
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], ["node", "hub"])


def _partners(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Components of what may link among the rows of a key, as far as sizes and sketches tell."""
    for t in runs(batches, ["key"]):
        if t.num_rows < 2:
            continue
        nodes = np.asarray(t.column("node"))
        order = np.argsort(nodes, kind="stable")
        sketches = [np.frombuffer(x, np.uint64) for x in t.column("sketch").to_pylist()]
        yield from _clusters(nodes[order], possible(np.asarray(t.column("size"))[order], [sketches[i] for i in order], num, den))


def _links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Components of what links among the rows of a key."""
    for t in runs(batches, ["key"]):
        if t.num_rows < 2:
            continue
        nodes = np.asarray(t.column("node"))
        order = np.argsort(nodes, kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        yield from _clusters(nodes[order], linked([sets[i] for i in order], num, den))


def _blocked(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component, size) rows with the keys of the block pairs that each takes part in: (node, key).

    A group that fits into a block is one. In others, sizes form steps of the factor that linked sets differ by at most,
    each step has blocks by hash, and a block meets those of its own and the next step. Blocks are bounded by rows and
    by the bits of their sketches, so that a run of two needs some tens of MB whatever the texts.
    """
    step = F.floor(F.log(F.col("size")) / math.log(den / num) if num < den else F.col("size") * 1.0).cast("int")
    rows = groups.withColumn("step", step)
    needed = F.greatest(F.ceil(F.col("n") / SKETCHES), F.ceil(F.col("total") / BITS)).cast("int")
    steps = rows.groupBy("component", "step").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    maps = [F.map_from_entries(F.collect_list(F.struct("step", x))).alias(name) for name, x in (("blocks", needed), ("sizes", F.col("n")))]
    whole = steps.groupBy("component").agg(F.sum("n").alias("rows"), F.sum("total").alias("all"), *maps)
    of = lambda d: F.coalesce(F.try_element_at("blocks", F.col("step") + d), F.lit(0))
    own = F.pmod(F.xxhash64("node"), of(0)).cast("int")
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda s, i, t, j: F.concat_ws("/", F.col("component"), s, i, t, j)
    keys = F.when((F.col("rows") <= SKETCHES) & (F.col("all") <= BITS), F.array(F.col("component").cast("string"))).otherwise(
        F.concat(
            F.transform(seq(of(0)), lambda j: key(F.col("step"), F.least(j, F.col("own")), F.col("step"), F.greatest(j, F.col("own")))),
            F.transform(seq(of(1)), lambda j: key(F.col("step"), F.col("own"), F.col("step") + 1, j)),
            F.transform(seq(of(-1)), lambda j: key(F.col("step") - 1, j, F.col("step"), F.col("own"))),
        )
    )
    # stored, so that both sides of the join follow their shuffles at once and Spark splits a hot component
    joined = rows.join(stored(whole.filter("rows > 1"), "whole"), "component").filter((F.coalesce(F.try_element_at("sizes", "step"), F.lit(0)) > 1) | (of(1) > 0) | (of(-1) > 0))
    return joined.withColumn("own", own).select("node", F.explode(keys).alias("key"))


def _blocks() -> Column:
    """How many blocks of sets n rows of total shingles make."""
    return F.greatest(F.ceil(F.col("n") / ROWS), F.ceil(F.col("total") / SHINGLES), F.lit(1)).cast("int")


def _verified(docs: DataFrame, near: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, hub) links of docs (doc_id, text), enough to connect what is connected, within components of near (node, component, size)."""
    texts = docs.withColumnRenamed("doc_id", "node")
    hash_ = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    to = lambda blocks: F.sequence(F.lit(0), blocks - 1)

    def met(rows: DataFrame, keys: Column) -> DataFrame:
        """Links among the rows of each key; a row (of a few numbers, so few() holds) has its keys made beside its set."""
        sets = arrow(_sets, texts.join(few(rows), "node"), f"{', '.join(f'{c} {k}' for c, k in rows.dtypes)}, set binary".replace("bigint", "long"), n)
        dealt = sets.select("node", F.explode(keys).alias("key"), "set").select("key", "node", "set").repartition(F.col("key")).sortWithinPartitions("key")
        return stored(arrow(_links, dealt, "node long, hub long", num, den), "links")

    key = lambda *parts: F.concat_ws("/", F.col("component"), *parts)
    whole = near.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select("component", _blocks().alias("blocks"))
    placed = stored(near.join(stored(whole, "whole"), "component").groupBy("node", "component").agg(F.max("blocks").alias("blocks")).withColumn("own", hash_(F.col("blocks"))), "near")
    first = met(placed, F.when(F.col("node") == F.col("component"), F.transform(to(F.col("blocks")), lambda i: key(i))).otherwise(F.array(key(F.col("own")))))
    large = placed.filter("blocks > 1")
    if not large.limit(1).count():
        return first

    # of components in several blocks: rows outside of the largest cluster meet all blocks
    labels = components(first).withColumnRenamed("component", "label")
    labelled = stored(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    sized = labelled.join(near.groupBy("node").agg(F.sum("size").alias("size")), "node")
    clusters = stored(sized.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "clusters")
    largest = clusters.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("all_n"), F.sum("total").alias("all_total"), F.max(F.struct("n", "label", "total")).alias("m"))
    outer = largest.select("component", "largest", (F.col("all_n") - F.col("m.n")).alias("n"), (F.col("all_total") - F.col("m.total")).alias("total")).filter("n > 0")
    rows = labelled.join(few(stored(outer.select("component", "largest", _blocks().alias("others")), "outer")), "component")
    rows = rows.withColumn("other", F.when(F.col("label") != F.col("largest"), hash_(F.col("others")))).select("node", "component", "blocks", "own", "others", "other")
    meet = F.array_distinct(F.concat(F.transform(to(F.col("others")), lambda j: key(F.lit("outer"), F.col("own"), j)), F.when(F.col("other").isNotNull(), F.transform(to(F.col("blocks")), lambda i: key(F.lit("outer"), i, F.col("other")))).otherwise(F.array().cast("array<string>"))))
    return first.unionByName(met(stored(rows, "outer"), meet))


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_shingles, component_id): equal components for what links reach."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    first = stored(arrow(_sizes, docs, "doc_id long, n_shingles long, digest binary, chunk int, cells binary", n), "sizes")
    sizes = first.filter("n_shingles is not null").select("doc_id", "n_shingles", "digest")
    chunks = first.filter("chunk is not null").select("chunk", "cells").repartition(F.col("chunk")).sortWithinPartitions("chunk")
    table = spark.sparkContext.broadcast(levels(arrow(_sum_cells, chunks, "chunk int, cells binary").toArrow()))  # CELLS numbers at any size

    # sides of joins are stored where a key may be hot: Spark splits the partitions of a join that follows its shuffles at once
    prefixes = stored(arrow(_prefixes, docs, "node long, size long, shingles array<long>, sketch binary", n, num, den, table), "prefixes")
    postings = prefixes.select("node", "size", F.explode("shingles").alias("shingle"))
    shared = stored(postings.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("shingle", "hub"), "shared")
    release(spark)
    groups = postings.join(shared, "shingle").select("node", "size", F.col("hub").alias("component")).distinct()

    some = sizes.filter("doc_id is not null and n_shingles > 0")
    equal = stored(some.groupBy("digest").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")), "equal")
    chosen = stored(groups.join(equal.select(F.col("hub").alias("node")).distinct(), "node", "left_semi"), "groups")
    release(spark)
    keyed = stored(_blocked(chosen, num, den), "blocks")
    likely = keyed.join(prefixes.select("node", "size", "sketch"), "node").select("key", "node", "size", "sketch")
    partners = stored(arrow(_partners, likely.repartition(F.col("key")).sortWithinPartitions("key"), "node long, hub long", num, den), "partners")
    release(spark)
    near = stored(components(partners).join(prefixes.select("node", "size"), "node"), "near")
    for t in (shared, chosen, keyed, partners):
        remove(t)
    remove(prefixes)
    found = _verified(docs, near, n, num, den)
    release(spark)

    heads = stored(equal.filter("n > 1").select("digest", "hub"), "heads")
    result = components(found.unionByName(some.join(few(heads), "digest").select(F.col("doc_id").alias("node"), "hub")))
    return sizes.join(result.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


ORACLE = r"""
with recursive d as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
s as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from d),
e as materialized (select doc_id, len(s) as n, unnest(s) as g from s),
o as materialized (select a.doc_id as x, b.doc_id as y, count(*) as i, any_value(a.n) as m, any_value(b.n) as n from e a join e b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by 1, 2),
l as materialized (select x, y from o where 100 * i >= 90 * (m + n - i)),
r(x, y) as (select doc_id, doc_id from s union select r.x, l.y from r join l on r.y = l.x)
select s.doc_id, cast(len(s) as bigint) as n_shingles, min(r.y) as component_id from s join r on r.x = s.doc_id group by s.doc_id, len(s)
"""
