"""Packing of tokenized documents into windows by minimum bin slack.

Documents are tokenized once; a piece per full window is cut off, and what remains of each document is a piece to be
packed. Only a histogram of the remaining lengths (at most ``window`` - 1 entries) goes to the driver. There, each step
takes the longest length left and finds, by subset sums over a bitset, the multiset of lengths that fills the window
closest to its capacity; going back over the bitsets gives its counts, and the multiset is repeated as often as the
histogram allows, so there are about as many steps as lengths however many documents there are. The steps give each
rank within a length its window and offset; every piece finds its own by a binary search in that table.

Tokenization keeps the ids of the parts that the tokenizer itself splits a text into (in texts with other characters
than PLAIN has, of the chunks between ASCII white space, over which its splitting never reaches), so that equal parts
are seldom encoded twice in a worker; when the cache is full, what was not used since it was last full is forgotten.

Defined cases: a null or empty text is the closing id alone; rows that repeat are packed as often as they come; a null
id is kept; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import SPACE, arrow, slices, stored

WINDOW = 4096
END = 2
END_OF_WORD = "</w>"
CACHED = 300_000
#: Texts of white space, ASCII without apostrophes and Latin-1 letters. The tokenizer splits these into words, single
#: digits and runs of punctuation, and lower-cases each letter by itself, so the ids of a text are those of its parts.
PLAIN = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*")
SPLIT = re.compile(SPACE)
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


class Encoder:
    """Ids of whole texts by a tokenizer file, with the ids of parts kept."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cached = cached
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(END_OF_WORD)]] = True

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            for w, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def learn_parts(self, new: list[str]) -> None:
        """As learn(), of parts of plain texts: as one text, cut after each id that ends a word."""
        ids = np.array(self.model.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(new):
            return self.learn(new)
        raw = ids.tobytes()
        self.known.update(zip(new, [raw[a:z] for a, z in zip([0, *stops], stops)]))

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        plain = PLAIN.fullmatch(text) and "<|" not in text
        parts = PARTS.findall(text.lower()) if plain else SPLIT.split(text)
        if new := set(parts).difference(self.known):
            if len(self.known) > self.cached:
                self.old, self.known = self.known, {}
                new = set(parts)
            if kept := {w for w in new if w in self.old}:
                self.known.update((w, self.old[w]) for w in kept)
                new -= kept
            if new:
                (self.learn_parts if plain else self.learn)(list(new))
        return b"".join(map(self.known.__getitem__, parts))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode = Encoder(path)
    part = TaskContext.get().partitionId()
    seen = np.zeros(window + 1, np.int64)
    end = np.array([END], "<u4").tobytes()
    for b in slices(batches, "text", 1 << 22):
        cols: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            ids = encode(text or "") + end
            n = len(ids) // 4
            for start in range(0, n, window):
                length = min(window, n - start)
                row = (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, int(seen[length]))
                seen[length] += 1
                for c, v in zip(cols, row):
                    c.append(v)
        out = [pa.array(c, pa.int64()) for c in cols]
        yield pa.RecordBatch.from_arrays([*out, pa.array([part] * len(cols[0]), pa.int32())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part"])


def fill(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often to take each size, at most its count, for the largest sum up to the capacity.

    Bit s of the set after an item tells that sum s can be made from the items so far. A size with a count c counts as
    items of 1, 2, 4 ... times the size. Sizes are tried in the order given, until the capacity is met exactly.
    """
    full = (1 << (capacity + 1)) - 1
    items, sets, now = [], [1], 1
    for i, (s, c) in enumerate(zip(sizes, counts)):
        c, k = min(c, capacity // s) if s else 0, 1
        while c > 0:
            k = min(k, c)
            now |= (now << (k * s)) & full
            items.append((i, k))
            sets.append(now)
            c, k = c - k, 2 * k
        if now >> capacity & 1:
            break
    left, taken = now.bit_length() - 1, [0] * len(sizes)
    for (i, k), before in zip(reversed(items), reversed(sets[:-1])):
        if not before >> left & 1:
            taken[i] += k
            left -= k * sizes[i]
    return taken


def slots(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, how many of it in a window, first window, offset, windows) for all ranks of all lengths."""
    left = dict(sorted(((n, c) for n, c in histogram.items() if c > 0), reverse=True))
    used = dict.fromkeys(left, 0)
    rows, first = [], 0
    while left:
        top = next(iter(left))
        others = {n: c - (n == top) for n, c in left.items() if c > (n == top)}
        keys = list(others)
        taken = dict(zip(keys, fill(keys, list(others.values()), window - top))) if top < window else {}
        chosen = {n: k for n in left if (k := taken.get(n, 0) + (n == top))}
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for n, k in chosen.items():
            rows.append((n, used[n], k, first, offset, times))
            offset += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        first += times
    return sorted(rows)


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = table[:, 0] << 44 | table[:, 1]
    for b in batches:
        if b.num_rows == 0:
            continue
        length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
        row = table[np.searchsorted(order, length << 44 | rank, side="right") - 1]
        nth, each = rank - row[:, 1], row[:, 2]
        sequence, offset = row[:, 3] + nth // each, row[:, 4] + nth % each * length
        yield pa.RecordBatch.from_arrays([b.column(c) for c in NAMES[:5]] + [pa.array(sequence), pa.array(offset)], NAMES)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of docs (doc_id, text) with their sequence and offset: see NAMES."""
    pieces = stored(arrow(_pieces, docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA.replace("sequence_id long, offset", "nth") + ", part int", tokenizer, window), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most a row for each length of a window
    table = np.array(slots(histogram, window) or [(0,) * 6], np.int64)
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("before"))
    return arrow(_place, ranked.select(*NAMES[:5], "rank"), SCHEMA, table)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
