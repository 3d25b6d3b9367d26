"""Language-model scores of whole texts by a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of a text, lower-cased in A-Z, and one end. What the neural part predicts are units: each of the
``vectors`` most frequent training words, the end, and for each of ``REST`` buckets, by hash of their last two bytes, all
other words of that bucket. Within a bucket a word has its share of counts, smoothed by 0.1 and with one such share for
what is unseen, so probabilities over the vocabulary and one unseen word for each bucket sum to one. Every unit has a
vector as a context and one as a prediction. The vectors of the ``CONTEXT`` units before a token, by a matrix for each
position, predict a vector, whose product with a unit's plus a bias is that unit's score. To normalise over tens of
thousands of units, a unit's probability is that of its class times its own within the class: the ``classes`` most
frequent words and the end are classes of their own; the others of a bucket form classes of at most ``MEMBERS``. Both are
normalised by batched matrix products, the second over the tokens of one class at a time.

All training texts are counted by a distributed aggregation, and the model is trained on every token of them. A round
takes one of ``ROUNDS`` parts of the texts, by hash. Its tasks, as many as the tokens of the part need at ``SHARD`` tokens each and
``SHARDS`` at least, train copies of the model on their own rows; a task with few tokens goes over them again until
``STEPS`` batches are done. After the round, the copies are averaged on the executors, each vector weighted by how often
its unit occurred in the task, so that a word of few texts is not drawn back by tasks that have none. Only the averaged
parameters, of a fixed number, come to the driver. Biases start as logarithms of shares, so the model starts as the
smoothed unigram model.

In scoring, the ``KNOWN`` most frequent words are looked up in a table that each worker holds; the others, rare words
without hot keys, are joined with the counts.

Defined cases: a null or empty text is the end alone; a null id counts as the empty text for the fold, so it is held
out; rows that repeat give equal rows; further columns are ignored; without training texts, words have the whole rest
and no score; an empty table gives no rows; texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import arrow, slices, stored

CLASSES, VECTORS, KNOWN = 128, 32_768, 200_000
REST, MEMBERS = 128, 256
CONTEXT, DIMENSION, BATCH, NOISE, NOISE_WITHIN, RATE, START = 3, 24, 2048, 64, 8, 0.1, 0.5
ROUNDS, SHARDS, SHARD, STEPS = 3, 8, 8_000_000, 120  # SHARD: tokens
WIDTH = DIMENSION + 2 - DIMENSION % 2  # of a predicted vector, then 1 for the bias, and 0 if that makes it even
GROUP = 8  # tokens of a class that are multiplied with its noise at once
MIXED = 1 << 16  # tokens that are put in random order at once
PIECE = 1 << 15  # numbers of a row of parameters
CACHED = 1 << 17  # scores that stay in a cache
SMOOTH = 0.1
ENDS = "\n"  # no word
FLUSH = 250_000  # distinct words that a task counts before it passes them on


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as words() has them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at either end of a text leaves an empty string
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return flat.filter(some), np.diff(before[offsets - offsets[0]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

    for b in slices(batches, "text"):
        found = tokens(b.column("text"))[0].value_counts()
        held += [pa.table({"word": found.field(0), "n": found.field(1)}), pa.table({"word": [ENDS], "n": [b.num_rows]})]
        rows += len(found) + 1
        if rows > 2 * FLUSH:
            held = [summed()]
            rows = held[0].num_rows
            if rows > FLUSH:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from summed().to_batches()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % REST


class Vocabulary:
    """The frequent words of a corpus with their counts; the first of them, the end and the rest by buckets are units.

    rest: counts and distinct words, by bucket, of the words that are not in ``frequent``.
    """

    def __init__(self, frequent: list[tuple[str, int]], tokens: int, distinct: int, ends: int, classes: int, vectors: int, rest: dict[int, tuple[int, int]]):
        names = [w.encode() for w, _ in frequent]
        self.counts = np.array([c for _, c in frequent], np.int64)
        self.tokens, self.distinct, self.ends = tokens, distinct, ends
        self.base_total = tokens + SMOOTH * (distinct + 1)
        self.names = pa.array([w for w, _ in frequent], pa.string())
        self.vectors = min(vectors, len(names))
        own = min(classes, self.vectors)
        self.bucket_totals = np.full(REST, SMOOTH)  # one share for what is unseen
        for b, (c, k) in rest.items():
            self.bucket_totals[b] += c + SMOOTH * k
        for w, c in zip(names[self.vectors :], self.counts[self.vectors :]):
            self.bucket_totals[bucket(w)] += c + SMOOTH

        self.unit = np.zeros(len(names), np.int32)  # of each frequent word
        self.rest_unit = np.zeros(REST, np.int32)
        self.unit[:own] = np.arange(own)
        self.end = own
        masses = [*(self.counts[:own] + SMOOTH), ends + SMOOTH]
        starts = list(range(own + 1))
        members: list[list[int]] = [[] for _ in range(REST)]
        for i, w in enumerate(names[own : self.vectors], own):
            members[bucket(w)].append(i)
        for b, found in enumerate(members):
            starts.append(len(masses))
            self.rest_unit[b] = len(masses)
            masses.append(self.bucket_totals[b])
            for i in found:
                if len(masses) - starts[-1] == MEMBERS:
                    starts.append(len(masses))
                self.unit[i] = len(masses)
                masses.append(self.counts[i] + SMOOTH)
        for i, w in enumerate(names[self.vectors :], self.vectors):
            self.unit[i] = self.rest_unit[bucket(w)]
        mass = np.array(masses, np.float64)
        self.n, self.start = len(mass), len(mass)  # the start is a context only
        self.starts = np.array([*starts, len(mass)])  # of classes
        self.of = np.repeat(np.arange(len(starts)), np.diff(self.starts)).astype(np.min_scalar_type(len(starts)))  # class of each unit
        # numbers of 16 bits, where these do, sort faster
        self.unit, self.rest_unit = (x.astype(np.min_scalar_type(self.start)) for x in (self.unit, self.rest_unit))
        totals = np.add.reduceat(mass, self.starts[:-1])
        self.class_shares = totals / totals.sum()
        self.shares = mass / totals[self.of]  # within the class

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w.encode(): i for i, w in enumerate(self.names.to_pylist())}

    def units(self, flat: pa.Array, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word among the frequent, else -1, and its unit. alone: only units are asked for, and -1 is also each index of a word without a vector."""
        names = self.names.slice(0, self.vectors) if alone else self.names
        ids = pc.fill_null(pc.index_in(flat, value_set=names.cast(flat.type)), -1).to_numpy()
        units = self.unit[ids] if len(self.unit) else np.zeros(len(ids), self.unit.dtype)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            ends = pc.binary_slice(flat.take(pa.array(unknown)).cast(pa.binary()), -2).dictionary_encode()
            of = np.array([bucket(w) for w in ends.dictionary.to_pylist()])
            units[unknown] = self.rest_unit[of[ends.indices.to_numpy()]]
        return ids, units


def joined(texts: list | pa.Array, v: Vocabulary, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of all texts in a row: indexes of words (of an end: -2), units, positions of ends; and the words. alone: as units()."""
    flat, sizes = tokens(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    last = np.cumsum(sizes + 1) - 1
    ids, units = np.full(len(flat) + len(sizes), -2, np.int32), np.full(len(flat) + len(sizes), v.end, v.unit.dtype)
    word = np.ones(len(ids), bool)
    word[last] = False
    ids[word], units[word] = v.units(flat, alone)
    return ids, units, last, flat


def contexts(units: np.ndarray, last: np.ndarray, start: int) -> np.ndarray:
    """The units before each token of joined texts, the nearest first; last: where texts end."""
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(units)) - np.repeat(first, np.diff(np.concatenate([first, [len(units)]])))
    out = np.full((len(units), CONTEXT), start, units.dtype)
    for k in range(1, CONTEXT + 1):
        out[k:, k - 1] = units[:-k]
        out[place < k, k - 1] = start
    return out


def _order(x: np.ndarray) -> np.ndarray:
    return np.argsort(x, kind="stable" if x.itemsize < 4 else None)  # of 16 bits: by digits


def _run_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at starts. Two columns, of an even number, are added as one complex number, in half the calls."""
    return np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32)


def _summed(rows: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their gradients."""
    order = _order(rows)
    rows = np.take(rows, order)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[starts], _run_sums(np.take(gradients, order, axis=0), starts)


def _lack(scores: np.ndarray) -> np.ndarray:
    """What the logistic function of scores lacks of one."""
    with np.errstate(over="ignore"):  # of infinity, it is zero
        np.exp(scores, out=scores)
    scores += 1
    return np.reciprocal(scores, out=scores)


class Model:
    """Log-bilinear: p = sum of r_u C_k over the units before; score of class k: p . g_k + a_k; of unit w in it: p . q_w + b_w."""

    def __init__(self, v: Vocabulary, seed: int = 0):
        d, rng = DIMENSION, np.random.default_rng(seed)
        self.v = v
        self.r = rng.normal(0, 0.1, (v.n + 1, d)).astype(np.float32)
        self.c = np.stack([np.eye(d, dtype=np.float32) for _ in range(CONTEXT)])
        self.g = rng.normal(0, 0.1, (len(v.class_shares), d)).astype(np.float32)
        self.a = np.log(v.class_shares).astype(np.float32)
        self.q = np.zeros((v.n, d), np.float32)
        self.b = np.log(v.shares).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.c, self.g, self.a, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Model:
        for p in self.parts():
            p.ravel()[:] = flat[: p.size]
            flat = flat[p.size :]
        return self


class Scorer:
    """Log probabilities by a model. Vectors have one more number: 1 in those predicted, the bias in those of classes and units.

    What a unit adds to the predicted vector is multiplied out once, for each position.
    """

    def __init__(self, m: Model):
        self.v = m.v
        self.r = [np.column_stack([m.r @ c, np.full(len(m.r), i == 0, np.float32)]) for i, c in enumerate(m.c)]
        self.g = np.ascontiguousarray(np.column_stack([m.g, m.a]).T)
        q, starts = np.column_stack([m.q, m.b]), m.v.starts
        self.q = [np.ascontiguousarray(q[i:j].T) for i, j in zip(starts, starts[1:])]
        self.ones = np.ones(max(len(m.g), *np.diff(starts)), np.float32)
        self.held = np.empty(max(CACHED, 64 * len(self.ones)), np.float32)

    def predicted(self, context: np.ndarray) -> np.ndarray:
        out = np.take(self.r[0], context[:, 0], axis=0)
        for k in range(1, CONTEXT):
            out += np.take(self.r[k], context[:, k], axis=0)
        return out

    def _shares(self, p: np.ndarray, vectors: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of p, the score of its column and the sum of all exponentials; vectors: one a column."""
        rows, n = len(p), vectors.shape[1]
        scores = np.matmul(p, vectors, out=self.held[: rows * n].reshape(rows, n))
        own = np.take(self.held, np.arange(0, rows * n, n) + columns)
        np.exp(scores, out=scores)
        return own, scores @ self.ones[:n]

    @staticmethod
    def _far(p: np.ndarray, vectors: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Logarithms of the shares where sums are beyond what a 32-bit number holds."""
        scores = (p @ vectors).astype(np.float64)
        top = scores.max(axis=1)
        return scores[np.arange(len(p)), columns] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))

    @staticmethod
    def _logs(own: np.ndarray, total: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return own - np.log(total.astype(np.float64))

    def log_probabilities(self, context: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all units."""
        v, n = self.v, len(units)
        k = v.of[units]
        order = _order(k)  # by class, so that the tokens of one are a slice
        k, columns = np.take(k, order), np.take(units, order)
        p, own, total = np.empty((n, DIMENSION + 1), np.float32), np.empty(n, np.float32), np.empty(n, np.float32)
        context = np.take(context, order, axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            step = max(64, CACHED // len(v.class_shares))
            for i in range(0, n, step):
                at = slice(i, i + step)
                p[at] = self.predicted(context[at])
                own[at], total[at] = self._shares(p[at], self.g, k[at])
            out = self._logs(own, total)
            far = np.flatnonzero(~np.isfinite(out))  # seldom
            if len(far):
                out[far] = self._far(p[far], self.g, k[far])
            ends = np.searchsorted(k, np.arange(len(v.class_shares) + 1))
            total[:], own[:] = 1, 0  # of a class of one unit
            several = np.flatnonzero((np.diff(ends) > 0) & (np.diff(v.starts) > 1))
            for j in several:
                low, high = v.starts[j], v.starts[j + 1]
                step = max(64, CACHED // (high - low))
                for i in range(ends[j], ends[j + 1], step):
                    at = slice(i, min(i + step, ends[j + 1]))
                    own[at], total[at] = self._shares(p[at], self.q[j], columns[at] - low)
            within = self._logs(own, total)
            for i in np.flatnonzero(~np.isfinite(within)):
                within[i] = self._far(p[i : i + 1], self.q[k[i]], columns[i : i + 1] - v.starts[k[i]])[0]
        out += within
        unsorted = np.empty(n)
        unsorted[order] = out
        return unsorted


class Trainer:
    """Noise-contrastive estimation with Adagrad, for classes and for units within them.

    Noise is by their shares: the same classes for all tokens of a batch, the same units for all of a class in it.
    """

    def __init__(self, model: Model, seed: int):
        self.m, self.rng, self.steps = model, np.random.default_rng(seed), 0
        self.seen = np.zeros(model.v.n + 1)  # tokens of each unit
        self.sums = [np.full(len(p), START, np.float32) for p in model.parts()]  # of a row, each number's share
        v = model.v
        self.noise, self.noise_within = np.log(NOISE * v.class_shares).astype(np.float32), np.log(NOISE_WITHIN * v.shares).astype(np.float32)
        self.classes, self.within = np.cumsum(v.class_shares), np.cumsum(v.shares)  # a class takes one of the second

    def _move(self, part: int, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        x, s = self.m.parts()[part], self.sums[part]
        flat = gradient.reshape(len(gradient), -1)
        now = s[rows] + np.einsum("rd,rd->r", flat, flat) / flat.shape[1]
        s[rows] = now
        gradient *= (RATE / np.sqrt(now)).reshape(-1, *[1] * (gradient.ndim - 1))
        if isinstance(rows, np.ndarray):
            gradient += np.take(x, rows, axis=0)
            x[rows] = gradient
        else:
            x += gradient

    def _classes(self, p: np.ndarray, k: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Learn which class follows, from tokens sorted by class; p: rows of WIDTH. The gradient of the vectors in p."""
        m, q = self.m, p[:, :DIMENSION]
        z = np.searchsorted(self.classes, self.rng.random(NOISE) * self.classes[-1] * (1 - 1e-9))
        own, other = np.take(m.g, k, axis=0), m.g[z]
        up = _lack(np.einsum("bd,bd->b", q, own) + np.take(m.a - self.noise, k))
        down = q @ other.T
        down += (m.a - self.noise)[z]
        _lack(down)
        down -= 1
        gradient = np.zeros((len(m.g), WIDTH), np.float32)
        gradient[k[starts]] = _run_sums(up[:, None] * p, starts)
        rows, against = _summed(z, down.T @ p)
        gradient[rows] += against
        self._move(2, gradient[:, :DIMENSION])
        self._move(3, gradient[:, DIMENSION])
        own *= up[:, None]
        own += down @ other
        return own

    def _units(self, p: np.ndarray, k: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Learn which unit of the class follows, from tokens sorted by class, all of bucket classes; as _classes()."""
        m, v = self.m, self.m.v
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        classes = k[starts][:, None].astype(np.int64)
        # the place of a class among the cumulated shares is its number
        z = np.searchsorted(self.within, classes + self.rng.random((len(starts), NOISE_WITHIN)) * (1 - 1e-9))
        z = np.clip(z, v.starts[classes], v.starts[classes + 1] - 1)
        own, bias = np.take(m.q, units, axis=0), m.b - self.noise_within
        up = _lack(np.einsum("bd,bd->b", p[:, :DIMENSION], own) + np.take(bias, units))
        # tokens of a class in rows of GROUP, so that products with its noise are of equal size; what fills the last row is 0
        sizes = np.diff(np.concatenate([starts, [len(k)]]))
        groups = -(-sizes // GROUP)
        first = np.cumsum(groups) - groups
        place = np.arange(len(k)) + np.repeat(first * GROUP - starts, sizes)
        rows = np.zeros((groups.sum() * GROUP, WIDTH), np.float32)
        rows[place] = p
        rows = rows.reshape(-1, GROUP, WIDTH)
        other = np.zeros((*z.shape, WIDTH), np.float32)
        other[:, :, :DIMENSION] = np.take(m.q, z, axis=0)
        other[:, :, DIMENSION] = np.take(bias, z)
        other = np.repeat(other, groups, axis=0)
        down = _lack(rows @ other.transpose(0, 2, 1))
        down -= 1
        down *= rows[:, :, DIMENSION, None]
        against = _run_sums((down.transpose(0, 2, 1) @ rows).reshape(len(rows), -1), first).reshape(-1, WIDTH)
        back = np.take((down @ other).reshape(-1, WIDTH), place, axis=0)[:, :DIMENSION]
        distinct, g = _summed(np.concatenate([units, z.ravel().astype(units.dtype)]), np.concatenate([up[:, None] * p, against]))
        self._move(4, g[:, :DIMENSION], distinct)
        self._move(5, g[:, DIMENSION], distinct)
        own *= up[:, None]
        own += back
        return own

    def step(self, context: np.ndarray, units: np.ndarray) -> None:
        m, k = self.m, self.m.v.of[units]
        order = _order(k)
        context, units, k = np.take(context, order, axis=0), np.take(units, order), np.take(k, order)
        before, c = np.take(m.r, context, axis=0).reshape(len(context), -1), m.c.reshape(-1, DIMENSION)
        p = np.zeros((len(context), WIDTH), np.float32)
        p[:, :DIMENSION], p[:, DIMENSION] = before @ c, 1
        g = self._classes(p, k, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])))
        i = np.searchsorted(k, m.v.end + 1)  # the end is the last unit that is a class of its own
        if i < len(k):
            g[i:] += self._units(p[i:], k[i:], units[i:])
        rows, total = _summed(context.ravel(), (g @ c.T).reshape(-1, DIMENSION))
        self._move(1, (before.T @ g).reshape(m.c.shape))
        self._move(0, total, rows)
        self.steps += 1

    def pass_over(self, context: np.ndarray, units: np.ndarray) -> None:
        """All tokens once, in batches of random order."""
        order = self.rng.permutation(len(units))
        for i in range(0, len(units), BATCH):
            self.step(np.take(context, order[i : i + BATCH], axis=0), np.take(units, order[i : i + BATCH]))

    def learn(self, texts: Iterator[list | pa.Array]) -> Trainer:
        """Every token of all texts once; of few, again until there were STEPS batches."""
        v, held, n, kept = self.m.v, [], 0, []

        def flush() -> None:
            nonlocal held, n
            context, units = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held, n = [], 0
            self.pass_over(context, units)
            self.seen += np.bincount(units, minlength=len(self.seen))
            if self.steps < STEPS:
                kept.append((context, units))

        for part in texts:
            _, units, last, _ = joined(part, v, True)
            held.append((contexts(units, last, v.start), units))
            n += len(units)
            if n >= MIXED:
                flush()
        if held:
            flush()
        while kept and self.steps < STEPS:
            for context, units in kept:
                self.pass_over(context, units)
        self.seen[v.start] = self.seen[v.end]
        return self

    def weights(self) -> np.ndarray:
        """How much each parameter counts in an average: by the tokens of its unit or class, of matrices by all."""
        v, d = self.m.v, DIMENSION
        seen = self.seen + 1e-3
        classes = np.add.reduceat(seen[: v.n], v.starts[:-1])
        parts = [np.repeat(seen, d), np.full(self.m.c.size, seen.sum()), np.repeat(classes, d), classes, np.repeat(seen[: v.n], d), seen[: v.n]]
        return np.concatenate(parts)


def _train(batches: Iterator[pa.RecordBatch], shared, seed: int) -> Iterator[pa.RecordBatch]:
    """(part, total, weight): pieces of the weighted parameters of a copy of the model that learnt all rows of the task."""
    from pyspark import TaskContext

    v, flat = shared.value
    model = Model(v).load(flat)
    trainer = Trainer(model, 1_000_003 * seed + TaskContext.get().partitionId()).learn(b.column("text") for b in slices(batches, "text", 1 << 21))
    if not trainer.steps:
        return
    weight = trainer.weights()
    total = model.flat() * weight
    for i in range(0, len(total), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), *(pa.array([x[i : i + PIECE].astype(np.float32).tobytes()], pa.binary()) for x in (total, weight))], ["part", "total", "weight"])


def _summed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums (part, total, weight) of rows sorted by part, holding one part and one batch at a time."""
    last, sums = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in sums)], ["part", "total", "weight"])

    for b in batches:
        for part, *values in zip(b.column("part").to_pylist(), b.column("total"), b.column("weight")):
            values = [np.frombuffer(x.as_buffer(), np.float32) for x in values]
            if part != last:
                if last is not None:
                    yield row()
                last, sums = part, [x.astype(np.float64) for x in values]
            else:
                for x, y in zip(sums, values):
                    x += y
    if last is not None:
        yield row()


def fit(train: DataFrame, v: Vocabulary) -> Model:
    """Train on all rows of train (doc_id, text)."""
    spark, model = train.sparkSession, Model(v)
    if not v.tokens:
        return model
    schema = "part int, total binary, weight binary"
    shards = max(SHARDS, -(-v.tokens // (ROUNDS * SHARD)))
    for k in range(ROUNDS):
        rows = train.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == k).select("text")
        # a table of few splits is small: its rows are dealt out; others keep their splits, several to a task
        rows = rows.repartition(shards) if rows.rdd.getNumPartitions() < shards else rows.coalesce(shards)
        shared = spark.sparkContext.broadcast((v, model.flat()))
        parts = arrow(_train, rows, schema, shared, k)
        for salts in ([-(-shards // 64)] if shards > 64 else []) + [1]:  # sums of sums, so that no task reads all copies
            salt = F.floor(F.rand(0) * salts).cast("int")
            dealt = parts.withColumn("salt", salt).repartition(F.col("part"), F.col("salt")).sortWithinPartitions("part", "salt").drop("salt")
            parts = arrow(_summed_parts, dealt, schema)
        got = sorted((r["part"], r["total"], r["weight"]) for r in parts.collect())  # a row for each piece of the parameters
        if got:
            total, weight = (np.concatenate([np.frombuffer(g[i], np.float32) for g in got]) for i in (1, 2))
            model.load(total / weight)
    return model


SCHEMA = "doc_id long, print long, word string, n long, n_tokens long, n_known long, base double, neural double"


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row of sums for each text (word: one that no text has), and a row for each rarer word of it."""
    v, flat = shared.value
    scorer = Scorer(Model(v).load(flat))
    logs = np.log10(v.counts + SMOOTH)
    log_end = np.log10(v.ends + SMOOTH)
    log_buckets = np.zeros(v.n)
    log_buckets[v.rest_unit] = np.log10(v.bucket_totals)
    in_rest = np.zeros(v.n, bool)
    in_rest[v.rest_unit] = True
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in slices(batches, "text"):
        texts, docs = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
        ids, units, last, flat = joined(b.column("text"), v)
        neural = np.empty(len(ids))
        before = contexts(units, last, v.start)
        for i in range(0, len(ids), 1 << 18):
            neural[i : i + (1 << 18)] = scorer.log_probabilities(before[i : i + (1 << 18)], units[i : i + (1 << 18)])
        known = ids >= 0
        share = np.where(known, logs[ids] if len(logs) else 0.0, 0.0)
        within = np.where(in_rest[units], share - log_buckets[units], 0.0)  # of a word in its bucket; rarer words follow
        share[last] = log_end
        first = np.concatenate([[0], last[:-1] + 1])
        total = lambda x: np.add.reduceat(x, first)
        prints = [xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in texts]
        k = len(texts)
        columns = {
            "doc_id": b.column("doc_id"), "print": pa.array(prints, pa.int64()), "word": pa.array([f"{ENDS}{p}" for p in prints]), "n": pa.nulls(k, pa.int64()),
            "n_tokens": pa.array(last - first + 1), "n_known": pa.array(total(known.astype(np.int64)) + (v.ends > 0)),
            "base": pa.array(total(share)), "neural": pa.array(total(neural) / np.log(10) + total(within)),
        }
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
        rare = np.flatnonzero(ids == -1)
        at = np.searchsorted(last, rare)  # the texts they are in, each with one end that is no word
        found = pa.table({"at": at, "word": flat.take(pa.array(rare - at))}).group_by(["at", "word"]).aggregate([("at", "count")]).combine_chunks()
        at, k = found.column("at").combine_chunks(), found.num_rows
        columns = {"doc_id": b.column("doc_id").take(at), "print": pa.array(prints, pa.int64()).take(at), "word": found.column("word").combine_chunks(), "n": found.column("at_count").combine_chunks()}
        yield pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(k, pa.float64() if c in ("base", "neural") else pa.int64())) for c in names], names)


def learn(docs: DataFrame, classes: int = CLASSES, frequent: int = KNOWN, vectors: int = VECTORS) -> tuple[Model, DataFrame]:
    """The model of the training fold of docs (doc_id, text), and the counts (word, c) of its words."""
    train = docs.select(F.col("doc_id").cast("long"), "text").filter(~held_out(F.col("doc_id")))
    counts = stored(arrow(_count, train.select("text"), "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    plain = counts.filter(F.col("word") != ENDS)
    step = F.floor(F.log2("c") * 16)
    steps = sorted(plain.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.sum("c").alias("c")).collect(), reverse=True)  # at most 16 for each bit
    ends = (counts.filter(F.col("word") == ENDS).agg(F.max("c")).first()[0]) or 0
    least, room = None, frequent
    for s in steps:
        if s["k"] > room:
            break
        least, room = s["s"], room - s["k"]
    in_table = step >= (least if least is not None else 1 << 20)
    top = plain.filter(in_table).toArrow().to_pylist()  # at most `frequent` rows
    top = sorted(((r["word"], r["c"]) for r in top), key=lambda r: (-r[1], r[0]))
    tokens, distinct = sum(s["c"] for s in steps) + ends, sum(s["k"] for s in steps) + (ends > 0)
    by_end = F.pmod(F.crc32(F.expr("substring(cast(word AS binary), -2, 2)")), F.lit(REST)).cast("int")  # as bucket()
    rest = {r["b"]: (r["c"], r["k"]) for r in plain.filter(~in_table).groupBy(by_end.alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect()}
    return fit(train, Vocabulary(top, tokens, distinct, ends, classes, vectors, rest)), counts


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the sizes and log10 probabilities of their texts by a model from learn()."""
    v = model.v
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = arrow(_score, docs, SCHEMA, docs.sparkSession.sparkContext.broadcast((v, model.flat())))
    joined_ = rows.join(counts.filter(F.col("word") != ENDS), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH)) * F.col("n")
    sums = joined_.groupBy("doc_id", "print").agg(
        F.count("n_tokens").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        F.sum("base").alias("base"), F.sum("neural").alias("neural"), F.coalesce(F.sum(log), F.lit(0.0)).alias("rare"),
    )
    each = lambda c: F.expr(f"{c} div copies")
    return sums.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), each("n_tokens").alias("n_tokens"), each("n_known").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + F.col("rare") - F.col("n_tokens") * float(np.log10(v.base_total))) / F.col("copies")).alias("base_score"),
        ((F.col("neural") + F.col("rare")) / F.col("copies")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def score(docs: DataFrame, classes: int = CLASSES, frequent: int = KNOWN, vectors: int = VECTORS) -> DataFrame:
    """docs (doc_id, text) with the sizes and log10 probabilities of their texts, learnt from the training fold."""
    return scored(docs, *learn(docs, classes, frequent, vectors))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
