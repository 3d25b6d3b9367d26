"""Similarity joins and line removal against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import closure, table, words
from weftarc.llm import embeddings, jaccard, lines
from weftarc.llm.common import components


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, f"c{j}") for j in range(60) for i in (j, j + 1)]
    rest = [(100 + rng.randrange(200), f"r{rng.randrange(120)}") for _ in range(250)]
    hot = [(1000 + i, "hot") for i in range(500)]
    rows = chain + rest + hot + [(None, "c0"), (5, None), (7000, "alone"), (100, "r0"), (100, "r0")]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "node long, hub string")).collect()}
    by = {}
    for n, h in rows:
        if n is not None and h is not None:
            by.setdefault(h, []).append(n)
    want = closure({n for n, h in rows if n is not None and h is not None}, [(ns[0], n) for ns in by.values() for n in ns])
    assert got == want


def shingle_set(text, n):
    w = [bytes(x).decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 1, 1)])
def test_jaccard(spark, n, num, den):
    rng = random.Random(n)
    rows = []
    for g in range(12):
        base = words(60 + 15 * g, seed=g).split()
        for _ in range(1 + g % 5 * 3):
            copy = base[:]
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(copy)))
    passage = words(40, seed=99)
    rows += [(len(rows) + i, words(120, seed=200 + i) + " " + passage) for i in range(20)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  B"), (505, "a b c"), (None, rows[0][1]), (0, rows[0][1]), (506, rows[3][1].upper() + "\n"), (507, words(30_000, seed=5)), (508, words(30_000, seed=5) + " x")]
    got = jaccard.join(table(spark, rows), n, num, den).collect()
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if None not in (a, b) and s and t and den * len(s & t) >= num * len(s | t)]
    want = closure({i for i, _ in rows if i is not None}, pairs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == sorted((i if i is not None else -1, len(s), want[i] if i is not None else -1) for i, s in sets)


@pytest.mark.parametrize("rows_,total", [(64, 10**9), (512, 4000), (512, 250_000)])
def test_jaccard_large_group(spark, monkeypatch, rows_, total):
    """A group of near copies of more than a block, by rows or by shingles, and a passage in all of many texts."""
    monkeypatch.setattr(jaccard, "ROWS", rows_)
    monkeypatch.setattr(jaccard, "SHINGLES", total)
    base = words(150, seed=1).split()
    rng = random.Random(0)
    rows = []
    for i in range(300):
        copy = base[:]
        copy[rng.randrange(len(copy))] = f"w{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, words(90, seed=10 + i) + " " + words(60, seed=3)) for i in range(150)]
    got = {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows), 3, 90, 100).collect()}
    sets = [(i, shingle_set(t, 3)) for i, t in rows]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if 100 * len(s & t) >= 90 * len(s | t)]
    assert got == closure({i for i, _ in rows}, pairs)


@pytest.mark.parametrize("rows_", [4, 16])
def test_jaccard_chains_over_blocks(spark, monkeypatch, rows_):
    """Components of more than a block that no single document links to all of: two chains of small changes, and a cluster beside each."""
    monkeypatch.setattr(jaccard, "ROWS", rows_)
    rng = random.Random(1)
    rows = []
    for g in range(2):
        now = words(300, seed=40 + g).split()
        for i in range(70):
            now[4 * i + g] = f"new{g}{i}"
            rows.append((rng.randrange(10**6), " ".join(now)))
        rows += [(rng.randrange(10**6), " ".join([*now[:-1], f"end{i}"])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows), 3, 90, 100).collect()}
    sets = [(i, shingle_set(t, 3)) for i, t in rows]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if 100 * len(s & t) >= 90 * len(s | t)]
    want = closure({i for i, _ in rows}, pairs)
    assert got == want and len(set(want.values())) == 2


def test_sketches_never_lose_a_link():
    """Pairs around the threshold, of sizes about powers of two, by sketches and by sets."""
    rng = np.random.default_rng(2)
    sets = []
    for n in (20, 60, 64, 70, 130, 260, 500, 515):
        base = rng.integers(0, 2**64, n, np.uint64)
        for k in range(6):
            sets.append(np.unique(np.concatenate([base[: n - k * n // 40], rng.integers(0, 2**64, k * n // 60, np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    for num in (80, 90):
        may = jaccard.possible(sizes, [np.frombuffer(jaccard.sketch(s), np.uint64) for s in sets], num, 100)
        link = jaccard.linked(sets, num, 100)
        assert link.any() and not (link & ~may).any() and may.sum() < 3 * link.sum()


def test_jaccard_of_nothing(spark):
    assert jaccard.join(table(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.join(table(spark, [(4, "")])).collect()] == [(4, 0, 4)]


def vectors(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("key", "node", "hub", "times", "dim", "filter", "block", "n")})


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(60):
        base = rng.normal(size=64)
        for _ in range(1 + g % 4):
            rows.append((len(rows), (base + rng.normal(size=64) * 0.12).astype(np.float32).tolist(), g % 3))
    tight = rng.normal(size=64)
    rows += [(1000 + i, (tight + rng.normal(size=64) * 0.05).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(40)] + [rows[5], (3000, rows[5][1], 7), (3001, [0.0] * 64, 1), (3002, None, 1), (3003, [1.0], 1), (3004, [], 1), (3005, rows[5][1], None)]
    rows += [(3006, [float("nan")] * 64, 1), (3007, [None] * 64, 1), (None, rows[5][1], 1), (3008, [float("inf")] * 64, 1)]
    got = embeddings.join(vectors(spark, rows)).collect()
    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    link = [[x != y and c == d and len(a) == len(b) and a @ b >= 0.98 for y, (_, b, d) in enumerate(good)] for x, (_, a, c) in enumerate(good)]
    exact = sum(map(sum, link))
    found = sum(r.n_links for r in got)
    assert 0.99 * exact <= found <= exact
    by = sorted((i, sum(n)) for (i, _, _), n in zip(good, link))
    assert sum(a != b for a, b in zip(by, sorted((r.vec_id, r.n_links) for r in got if r.vec_id in {i for i, *_ in good}))) <= 0.02 * len(by)
    want = closure({i for i, *_ in rows if i is not None}, [(good[x][0], good[y][0]) for x, row in enumerate(link) for y, on in enumerate(row) if on])
    wrong = [r for r in got if r.vec_id is not None and r.component_id != want[r.vec_id]]
    assert len(wrong) <= 3 and len(got) == len(rows)
    assert all(r.n_links == 0 for r in got if r.vec_id is None or r.vec_id >= 3000)


def test_embeddings_of_nothing(spark):
    assert embeddings.join(vectors(spark, [])).count() == 0


def test_list_decoding_is_complete():
    code = embeddings.Code(48, 3000, 16)
    x = np.random.default_rng(1).normal(size=(50, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, found = code.decode(x)
    turned = x @ code.rotation
    total = np.zeros((50, 1))
    for block, w in zip(code.blocks, code.words):
        total = (total[:, :, None] + (turned[:, block] @ w.T)[:, None, :]).reshape(50, -1)
    assert set(zip(row.tolist(), found.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(total >= code.bound))))


@pytest.mark.parametrize("size", [10_000, 100_000, 1_000_000])
def test_every_vector_has_filters_and_close_ones_share_some(size):
    """Pairs just over the threshold, with the codes of labels of any size."""
    rng = np.random.default_rng(3)
    x, g = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 600, 64)))
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    codes = {}
    a, b = (set(zip(*(v.tolist() for v in embeddings.passes(u, size, embeddings.HITS, codes)))) for u in (x, y))
    assert min(sum(r == i for r, _ in a) for i in range(600)) >= embeddings.HITS
    assert len({i for i, _ in a & b}) >= 0.995 * 600


def test_small_labels_are_compared_exactly(spark):
    """Beside a large label, which must not thin out the filters of a small one."""
    rng = np.random.default_rng(4)
    x, g = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 500, 64)))
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.9802 * x + np.sqrt(1 - 0.9802**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))] + [(5000 + i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(4000, 64)))]
    found = embeddings.join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).filter("n_links > 0").collect()
    assert {(r.vec_id, r.n_links) for r in found} == {(i, 1) for i in range(1000)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(s, k, rng):
    for _ in range(k):
        p, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        s = s[:p] + (rng.choice("abcxyzéü ") if kind < 2 else "") + s[p + (kind > 0) :]
    return s


@pytest.mark.parametrize("k", [1, 2, 3])
def test_within(spark, k):
    from pyspark.sql import functions as F

    rng = random.Random(k)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abé ") for _ in range(rng.randint(k + 1, 45)))
        b = edited(a, rng.randrange(k + 3), rng)
        if len(b) > k and abs(len(a) - len(b)) <= k:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), k).alias("w")).collect()
    assert all(r.w == (levenshtein(r.a, r.b) <= k) for r in got)


@pytest.mark.parametrize("k", [0, 1, 2])
def test_lines(spark, k):
    rng = random.Random(10 + k)
    pool = [words(8, seed=i) for i in range(25)]
    rows = []
    for i in range(60):
        body = [edited(rng.choice(pool), rng.randrange(4), rng) if rng.random() < 0.7 else words(6, seed=1000 + 7 * i) for _ in range(rng.randint(1, 6))]
        rows.append((i * 3 % 61, "\n".join(body)))
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "short"), (74, "short\nshort"), (None, rows[0][1]), (75, "  " + rows[4][1].split("\n")[0] + "\t\r\nx"), (76, "\n".join([pool[0]] * 3))]
    got = {r.doc_id: r for r in lines.remove_lines(table(spark, rows), k).collect()}
    blank = " \t\r\x0b\x0c"
    all_ = sorted((i, no, x.strip(blank)) for i, t in rows if i is not None and t is not None for no, x in enumerate(t.split("\n")) if len(x.strip(blank)) >= 25)
    gone = {(i, no) for at, (i, no, x) in enumerate(all_) if any(x == y or (k and abs(len(x) - len(y)) <= k and levenshtein(x, y) <= k) for _, _, y in all_[:at])}
    for i, t in rows:
        want = t if t is None or i is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)
        assert got[i].text == want, i
        assert got[i].key == "x"
    assert gone


def test_lines_repeated_rows_and_nothing(spark):
    line = words(10)
    got = lines.remove_lines(table(spark, [(1, line), (1, line), (2, line)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, line), (1, line), (2, "")]
    assert lines.remove_lines(table(spark, [])).count() == 0


def test_short_lines_go_when_equal(spark):
    line = words(10)
    docs = table(spark, [(1, f"Les.\n\n{line}\nA"), (2, f" Les.\n\nLes,\nA\n{line}x"), (3, "Les.")])
    got = {r.doc_id: r.text for r in lines.remove_lines(docs, exact=1).collect()}
    assert got == {1: f"Les.\n\n{line}\nA", 2: "\n\nLes,".replace("\n\n", "\n", 1), 3: ""}


def test_pipeline_drops_equal_lines_of_any_length(spark):
    import corpus_pipeline

    docs = table(spark, [(1, "Les.\none"), (2, "Les.\ntwo"), (3, "Les.")], extra=False)
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()} == {1: "Les.\none", 2: "two"}


def test_variants_of_one_line(spark, monkeypatch):
    """More lines to a key than are compared each with each: as many go as by brute force."""
    monkeypatch.setattr(lines, "HOT", 8)
    rng = random.Random(5)
    base = words(9, seed=2)
    body = [f"{base} {i}" for i in range(150)] + [f"{i} {base}" for i in range(60)] + [edited(base, rng.randrange(3), rng) for _ in range(120)]
    rng.shuffle(body)
    got = {r.doc_id: r.removed for r in lines.remove_lines(table(spark, list(enumerate(body)))).select("doc_id", F.size("removed").alias("removed")).collect()}
    want = {i: int(any(abs(len(x) - len(y)) <= 1 and levenshtein(x, y) <= 1 for y in body[:i])) for i, x in enumerate(body)}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_candidates_of_many_variants_are_linear(spark):
    n = 100_000
    rows = spark.range(n).select(F.xxhash64("id").alias("h"), F.col("id").cast("decimal(38,0)").alias("at"), F.concat(F.lit("the same words in every line and then a number "), F.format_string("%06d", "id")).alias("line"))
    single = rows.withColumn("n", F.char_length("line"))
    keys = single.select(F.explode(lines._halves(0)).alias("key")).groupBy("key").count().filter(F.col("count") > lines.HOT).select("key")
    assert lines._near_in(single, keys).distinct().count() <= 20 * n


def test_many_removed_lines_of_one_document(spark):
    body = "\n".join(["the same words in every line, again"] * 60_000)
    (r,) = lines.remove_lines(table(spark, [(1, body + "\nanother line that is like none of these")])).select("text", F.size("removed").alias("n")).collect()
    assert r.text.split("\n") == ["the same words in every line, again", "another line that is like none of these"] and r.n == 59_999


def near_pairs(n, near, seed=8):
    """n unit vectors of 64 dimensions of which the last `near` are at cosine 0.981 to the first ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=(near, 64))
    g -= (g * x[:near]).sum(1, keepdims=True) * x[:near]
    x[n - near :] = 0.981 * x[:near] + np.sqrt(1 - 0.981**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    return x


def test_recall_of_a_label_of_20_000(spark):
    """Every fiftieth vector against all rows, by brute force."""
    x = near_pairs(20_000, 4000)
    found = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.join(found).filter("vec_id % 50 = 0").collect()}
    close = x[::50] @ x.T >= 0.98
    want = {50 * i: int(row.sum()) - 1 for i, row in enumerate(close)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.98 * sum(want.values()) > 100


def test_recall_of_a_label_of_200_000():
    """Pairs of every fiftieth vector with all rows, by brute force, share a filter."""
    x = near_pairs(200_000, 20_000)
    codes = {}
    met = [set() for _ in range(len(x))]
    for at in range(0, len(x), 20_000):
        for r, f in zip(*(v.tolist() for v in embeddings.passes(x[at : at + 20_000], len(x), embeddings.HITS, codes))):
            met[at + r].add(f)
    pairs = [(50 * (at + i), j) for at in range(0, 4000, 500) for i, j in np.argwhere(x[50 * at : 50 * (at + 500) : 50] @ x.T >= 0.98).tolist() if 50 * (at + i) != j]
    assert len(pairs) > 400 and sum(bool(met[a] & met[b]) for a, b in pairs) >= 0.98 * len(pairs)


def test_embeddings_of_any_size(spark):
    """Components whose squares over- or underflow."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=16)
    rows = [(i, (v * s).tolist(), 1) for i, s in enumerate((1.0, 1e200, 1e-200, 1e307))] + [(9, rng.normal(size=16).tolist(), 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 9: (0, 9)}
