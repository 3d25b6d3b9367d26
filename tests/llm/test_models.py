"""Language model, classifiers, mixing, packing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import table, words
from weftarc.llm import lm, mixing, packing, quality
from weftarc.llm.packing import Encoder, fill, slots, tokenizer_path


def test_lm(spark):
    rows = [(i, words(80, seed=i, size=120)) for i in range(60)] + [(1000, None), (1001, ""), (None, "null id"), (3, words(80, seed=3, size=120)), (1002, "Unseen WORDS here"), (1003, "unseen words here\x0b")]
    # words of one text are drawn in runs, so that a context helps
    rows = [(i, t if t is None else " ".join(w for x in t.split() for w in (x, "then", x[:1] or "x"))) for i, t in rows]
    got = lm.score(table(spark, rows), classes=20, frequent=40).collect()
    assert len(got) == len(rows)
    split = lambda t: [bytes(w).decode() for w in (t or "").encode().lower().split()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in [*split(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in rows:
        tokens = [*split(t), "\n"]
        want[i] = (held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6
    out = [r for r in got if r.held_out]
    assert len(out) > 3 and sum(r.score for r in out) > sum(r.base_score for r in out)


def small_model(monkeypatch):
    """A model with classes of several members, bucket units and words beyond the vectors, a little trained."""
    monkeypatch.setattr(lm, "REST", 4)
    monkeypatch.setattr(lm, "MEMBERS", 3)
    frequent = [(f"w{chr(97 + i)}{i % 3}", 60 - i) for i in range(30)]
    v = lm.Vocabulary(frequent, 5000, 60, 200, 3, 24, {1: (30, 9), 2: (5, 5)})
    rng = random.Random(0)
    texts = [" ".join(rng.choice(frequent)[0] for _ in range(40)) for _ in range(40)]
    model = lm.Model(v)
    lm.Trainer(model, 1).learn(iter([texts]))
    return v, model, texts


def test_lm_is_normalised(monkeypatch):
    """Probabilities over all words, the end and an unseen word for each bucket sum to one, after any units."""
    v, m, _ = small_model(monkeypatch)
    before = np.random.default_rng(0).integers(0, v.start + 1, (50, lm.CONTEXT)).astype(np.int32)
    total = sum(np.exp(lm.Scorer(m).log_probabilities(before, np.full(50, u, np.int32))) for u in range(v.n))
    assert np.allclose(total, 1, atol=1e-5)
    assert v.n == 3 + 1 + 21 + 4 and len(v.class_shares) > 3 + 1 + 4 and np.isclose(v.class_shares.sum(), 1)
    inside = np.zeros(lm.REST)
    for i, (w, c) in enumerate(zip(v.index, v.counts)):
        if i >= v.vectors:
            inside[lm.bucket(w)] += c + 0.1
    for b, (c, k) in {1: (30, 9), 2: (5, 5)}.items():
        inside[b] += c + 0.1 * k
    assert np.allclose(inside + 0.1, v.bucket_totals)


def test_lm_scores_equal_a_plain_loop(monkeypatch):
    v, m, texts = small_model(monkeypatch)
    texts = [*texts[:3], "wa0 unknown wz9 wd0", ""]
    _, units, last, _ = lm.joined(texts, v)
    got = np.split(lm.Scorer(m).log_probabilities(lm.contexts(units, last, v.start), units), last[:-1] + 1)
    for found, words_ in zip(got, map(lm.words, texts)):
        of = [int(v.unit[v.index[w]]) if w in v.index else int(v.rest_unit[lm.bucket(w)]) for w in words_] + [v.end]
        for i, u in enumerate(of):
            p = sum(m.r[of[i - k] if i >= k else v.start].astype(float) @ m.c[k - 1] for k in range(1, lm.CONTEXT + 1))
            classes = [float(p @ g + a) for g, a in zip(m.g, m.a)]
            members = {j: float(p @ m.q[j] + m.b[j]) for j in range(v.n) if v.of[j] == v.of[u]}
            want = classes[v.of[u]] - np.log(sum(map(np.exp, classes))) + members[u] - np.log(sum(map(np.exp, members.values())))
            assert abs(found[i] - want) < 1e-4


def test_lm_units_alone_are_the_same(monkeypatch):
    """Training looks up only words with vectors: units are those of a lookup of all."""
    v, _, texts = small_model(monkeypatch)
    texts = [*texts[:3], "wa0 unknown wz9 wd0", "", "wz1 w"]
    whole, alone = lm.joined(texts, v), lm.joined(texts, v, True)
    assert np.array_equal(whole[1], alone[1]) and np.array_equal(whole[2], alone[2]) and (whole[0] >= v.vectors).any() and not (alone[0] >= v.vectors).any()


def test_lm_scores_beyond_32_bits(monkeypatch):
    """Scores whose exponentials overflow, of classes and within them."""
    v, m, texts = small_model(monkeypatch)
    _, units, last, _ = lm.joined(texts[:3], v)
    before = lm.contexts(units, last, v.start)
    want = lm.Scorer(m).log_probabilities(before, units)
    m.a += 200
    m.b += 200
    assert np.allclose(lm.Scorer(m).log_probabilities(before, units), want, atol=1e-3)


def test_lm_tokens_equal_plain_words():
    """Words by Arrow are those of plain splitting, for every character, white space anywhere, nulls and slices."""
    every = "".join(f"{chr(i)}Q" for i in range(1, 0x3100))
    texts = ["x", None, "", "  A\tb\x0b\x0cC \r\n", " ", every, "É\u00a0e\u2003f", "end "]
    for part in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(2, 5)):
        flat, sizes = lm.tokens(part)
        want = [lm.words(t) for t in part.to_pylist()]
        assert flat.cast(pa.binary()).to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]


def test_lm_counts_each_word(monkeypatch):
    """Counts that a task passes on in several parts are those of all its texts."""
    monkeypatch.setattr(lm, "FLUSH", 3)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(50)] + [None, ""]
    found = Counter()
    for b in lm._count(iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 4], pa.string())], ["text"]) for i in range(0, len(texts), 4)])):
        for r in b.to_pylist():
            found[r["word"]] += r["n"]
    want = Counter(w.decode() for t in texts for w in lm.words(t))
    assert found == want | Counter({lm.ENDS: len(texts)})


def test_lm_learns_from_every_token(monkeypatch):
    """A word of one text, behind more tokens than the steps have room for, is seen and moves its vectors."""
    monkeypatch.setattr(lm, "STEPS", 1)
    frequent = [("a", 200_000), ("b", 100_000), ("late", 1)]
    v = lm.Vocabulary(frequent, 300_002, 4, 1, 1, 3, {})
    start, m = lm.Model(v), lm.Model(v)
    trainer = lm.Trainer(m, 1).learn(iter([["a a b " * 100_000 + "late"]]))
    assert trainer.seen[: v.n].sum() == 300_002 and trainer.steps >= 300_002 // lm.BATCH
    u = v.unit[v.index[b"late"]]
    assert trainer.seen[u] == 1 and (m.r[u] != start.r[u]).any() and (m.q[u] != 0).any()


def test_lm_average_weighs_by_occurrence(spark, monkeypatch):
    """Copies of several tasks give one model; a word of a single text keeps what that text taught it."""
    rows = [(i, words(60, seed=i, size=50) + (" only once" if i == 20 else "")) for i in range(40)]
    model, _ = lm.learn(table(spark, rows), 5, 10_000)
    fresh = lm.Model(model.v)
    u = model.v.unit[model.v.index[b"only"]]
    assert np.isfinite(model.flat()).all() and np.abs(model.r[u] - fresh.r[u]).max() > 1e-3
    assert np.abs(model.g - fresh.g).max() > 1e-2


def test_lm_very_long_text(spark):
    long_ = "alpha beta gamma delta " * 60_000
    got = {r.doc_id: r for r in lm.score(table(spark, [(1, long_), (2, "alpha beta"), (3, long_)])).collect()}
    assert got[1].n_tokens == 240_001 and np.isclose(got[1].score, got[3].score) and got[1].score > got[1].base_score


def test_lm_without_training(spark):
    assert lm.score(table(spark, [])).count() == 0
    import itertools

    only = next(i for i in itertools.count() if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm.score(table(spark, [(only, "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and abs(r.base_score) < 1e-9


def test_encoder_equals_tokenizer():
    e = Encoder(tokenizer_path(), cached=50)
    rng = random.Random(0)
    texts = ["", "don't I'll 's x's", "A1b2 ²x éÉß a_b 3.5", "<|endoftext|> a<|endoftext|>b", "ΣΑΣ ς \x1c\x85 é", "a\xa0b", "12345 £4", "\x00a", "a b</w> c", "İI ǅ"]
    texts += ["".join(rng.choice("abcXYZéÀ 0'.,!\n\t-ß") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(e(t), "<u4").tolist() == e.model.encode(t, add_special_tokens=False).ids, t


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(300):
        sizes = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(0, 4) for _ in sizes]
        capacity = rng.randint(0, 60)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums |= {x + s * k for x in sums for k in range(c + 1) if x + s * k <= capacity}
        taken = fill(sizes, counts, capacity)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        assert sum(s * t for s, t in zip(sizes, taken)) == max(sums)


def check_pieces(got, rows, window):
    e = Encoder(tokenizer_path())
    ids = {}
    for i, t in rows:
        ids.setdefault(i, e(t or "") + np.array([2], "<u4").tobytes())
    by_doc, by_window = {}, {}
    for p in got:
        raw = ids[p.doc_id][4 * p.start : 4 * (p.start + p.length)]
        assert len(raw) == 4 * p.length and p.ids_crc32 == zlib.crc32(raw) and p.doc_tokens == len(ids[p.doc_id]) // 4
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
    copies = Counter(i for i, _ in rows)
    for i, ps in by_doc.items():
        assert sum(n for _, n in ps) == copies[i] * len(ids[i]) // 4
    assert set(by_doc) == set(copies)
    for ps in by_window.values():
        at = 0
        for o, n in sorted(ps):
            assert o == at
            at += n
        assert at <= window
    return by_window


@pytest.mark.parametrize("window", [64, 4096])
def test_pack(spark, window):
    rows = [(i, words(random.Random(i).randrange(200), seed=i)) for i in range(80)] + [(500, None), (501, ""), (7, words(random.Random(7).randrange(200), seed=7)), (None, "null"), (502, words(20_000))]
    got = packing.pack(table(spark, rows), tokenizer_path(), window).collect()
    windows = check_pieces(got, rows, window)
    total = sum(p.length for p in got)
    assert len(windows) <= -(-total // window) + 3
    assert sorted(windows) == list(range(len(windows)))


def test_pack_of_nothing(spark):
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0


def test_slots_use_each_rank_once():
    h = {5: 7, 9: 100_000, 64: 3, 33: 11, 31: 12, 1: 1}
    seen = Counter()
    for n, first, each, _, _, times in slots(h, 64):
        seen[n] += each * times
    assert seen == h


def quality_rows():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = words(40, seed=i, size=300).split()
        low, toxic = rng.random() < 0.2, rng.random() < 0.15
        if low:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["moronic", "wretch"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    known = spark.createDataFrame(labels[:250] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    extra = [(900, None), (901, ""), (None, "null id text"), (5, rows[5][1]), (902, words(40_000))]
    docs = table(spark, rows + extra)
    got = {r.doc_id: r for r in quality.judge(docs, known).collect()}
    right = sum(got[i].keep == (q == 1 and t == 0) for i, q, t in labels[250:])
    assert right >= 0.95 * len(labels[250:])
    kept = quality.kept(docs, known)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert {i for i in ids} == {i for i, r in got.items() if r.keep} and ids[5] == (2 if got[5].keep else 0)
    # without labels nothing is known, and nothing goes
    none = quality.judge(docs, known.limit(0)).collect()
    assert len(none) == len(rows + extra)
    assert quality.judge(table(spark, []), known).count() == 0


def test_sparse_sites_have_the_rate_above(spark):
    sites = spark.createDataFrame([("big", 10_000, 9000.0, 0.5), ("other", 10_000, 1000.0, 0.5), ("tiny", 1, 1.0, 0.5)], "h string, n long, low_sum double, above double")
    rate = {r.h: r.low_rate for r in quality._shrunk(sites, "low", "above").collect()}
    assert abs(rate["big"] - 0.9) < 0.01 and abs(rate["other"] - 0.1) < 0.01 and rate["tiny"] < 0.85


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    vocab = {"en": [f"the{i}" for i in range(50)], "fr": [f"le{i}" for i in range(50)], "de": [f"der{i}" for i in range(50)]}
    rows, labelled = [], []
    for i in range(600):
        d = rng.choice(["en"] * 6 + ["fr"] * 3 + ["de"])
        rows.append((i, " ".join(rng.choice(vocab[d]) for _ in range(rng.randint(3, 120)))))
        labelled.append((i, d))
    docs = table(spark, rows + [(1000, None), (1001, ""), (None, "the1 le2"), (3, rows[3][1])])
    seen = spark.createDataFrame(labelled[:200] + [(7, None), (None, "en")], "doc_id long, domain string")
    got, domains = mixing.mix(docs, seen, {"en": 0.3, "fr": 0.3, "de": 0.4})
    out = got.collect()
    assert domains == ["de", "en", "fr"] and len(out) == 604
    total = sum(r.n_tokens for r in out)
    for d, w in (("en", 0.3), ("fr", 0.3), ("de", 0.4)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) - w * total) < 1e-5 * total
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    # with a floor, which cuts off; the optimum satisfies the conditions of least squares
    got, _ = mixing.mix(docs, seen, {"en": 0.1, "fr": 0.3, "de": 0.6}, floor=0.5)
    out = got.collect()
    assert min(r.rate for r in out) >= 0.5
    lack = {d: w * total - sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in out) for d, w in (("en", 0.1), ("fr", 0.3), ("de", 0.6))}
    for r in out:
        slope = sum(lack[d] * r[f"p_{d}"] for d in domains)
        if r.n_tokens:
            assert slope <= 2e-3 * total if r.rate <= 0.5 + 1e-9 else abs(slope) <= 2e-3 * total
    # repeating only
    got, _ = mixing.mix(docs, seen, 0.7, floor=1.0, grow=True)
    assert min(r.copies for r in got.collect()) >= 1
    assert mixing.mix(table(spark, []), seen, 0.5)[0].count() == 0
    one, names = mixing.mix(docs, seen.limit(0))
    assert names == ["all"] and {r.copies for r in one.collect()} == {1}


def test_mixing_keeps_every_domain(spark):
    docs = table(spark, [(i, f"word{i % 20} of{i % 20}") for i in range(60)])
    seen = spark.createDataFrame([(i, f"d{i % 20:02}") for i in range(60)], "doc_id long, domain string")
    domains, prior, _ = mixing.fit(docs, seen)
    assert domains == [f"d{i:02}" for i in range(20)] and np.isclose(np.exp(prior).sum(), 1)
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mix(docs, seen, {"d00": 0.5, "nowhere": 0.5})


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_rows()
    good = [i for i, q, t in labels if q and not t][:40]
    texts = dict(rows)
    line = words(12, seed=77)
    rows += [(2000 + i, " ".join([*texts[g].split()[:-1], "ending"])) for i, g in enumerate(good[:10])]
    rows += [(3000 + i, line + "\n" + words(30, seed=5000 + i)) for i in range(5)] + [(4000, None), (4001, ""), (None, "null id " + words(9, seed=1)), (good[0], texts[good[0]])]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        if len(seen) < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.collect())
    judged = {r.doc_id for r in seen[0]}
    assert {i for i, q, t in labels if q and not t} <= judged | {-1} or len({i for i, q, t in labels if q and not t} - judged) < 10
    assert sum(line in (r.text or "").split("\n") for r in seen[1]) == 1
    last = {r.doc_id for r in seen[2]}
    assert not {2000 + i for i, g in enumerate(good[:10]) if g in judged} & last and {r.doc_id for r in seen[3]} == last
    assert {p.doc_id for p in seen[4]} == last
    check_pieces(seen[4], [(r.doc_id, r.text) for r in seen[3]], 4096)
    empty = tmp_path / "none"
    table(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_mixing_posteriors_against_plain_bayes(spark):
    from math import exp, log

    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["Aa", "bb", "cc", "dd", "ee"][i % 2 : 4 + i % 2]) for _ in range(rng.randint(0, 90)))) for i in range(80)] + [(900, None), (901, "AA bb\x0bzz")]
    domain = {i: ("odd", "even")[i % 2] for i in range(60)}
    docs = table(spark, rows)
    seen = spark.createDataFrame(list(domain.items()), "doc_id long, domain string")
    names, *model = mixing.fit(docs, seen)
    got = {r.doc_id: r for r in mixing.posteriors(docs, (names, *model)).collect()}
    split = lambda t: [bytes(w).decode() for w in (t or "").encode().lower().split()]
    known = sorted({w for _, t in rows for w in split(t)})
    at = {r.w: r.b for r in spark.createDataFrame([(w,) for w in known], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    count = {d: Counter(at[w] for i, t in rows if domain.get(i) == d for w in split(t)) for d in names}
    size = {d: sum(c.values()) + mixing.SMOOTH * mixing.BUCKETS for d, c in count.items()}
    for i, t in rows:
        w = split(t)
        flat = min(1, mixing.SOFT / max(1, len(w)))
        odds = [log(sum(x == d for x in domain.values()) / len(domain)) + flat * sum(log(count[d][at[x]] + mixing.SMOOTH) - log(size[d]) for x in w) for d in names]
        want = [exp(o - max(odds)) for o in odds]
        assert got[i].n_tokens == len(w)
        assert all(abs(got[i][f"p_{k}"] - x / sum(want)) < 1e-4 for k, x in enumerate(want))


def test_quality_against_plain_shrinking(spark):
    """Rates of hosts and paths, their strengths and the posteriors from the documents' evidence, in plain numbers."""
    from math import exp, log

    rows, labels = quality_rows()
    docs = table(spark, rows)
    known = spark.createDataFrame(labels[:250], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, known)
    out = quality.judge(docs, known, model=model).collect()

    def shrunk(sites, above):  # sites: name -> (documents, sum), above: name -> rate
        seen = sum(n * (s / n - above[k]) ** 2 for k, (n, s) in sites.items())
        chance = [above[k] * (1 - above[k]) for k in sites]
        between = max(0.0, seen - sum(chance)) / sum(n for n, _ in sites.values())
        strength = min(1e6, max(1.0, sum(chance) / len(chance) / between - 1)) if between else 1e6
        return {k: (s + strength * above[k]) / (n + strength) for k, (n, s) in sites.items()}

    for flaw in quality.FLAWS:
        p = {r.doc_id: 1 / (1 + exp(-r[f"{flaw}_odds"])) for r in out}
        hosts, paths = {}, {}
        for r in out:
            for sites, k in ((hosts, r.host), (paths, (r.host, r.path))):
                n, s = sites.get(k, (0, 0.0))
                sites[k] = (n + 1, s + p[r.doc_id])
        everywhere = sum(p.values()) / len(p)
        host_rate = shrunk(hosts, dict.fromkeys(hosts, everywhere))
        rate = shrunk(paths, {k: host_rate[k[0]] for k in paths})
        for r in out:
            own = min(max(rate[r.host, r.path], 1e-6), 1 - 1e-6)
            want = 1 / (1 + exp(-(r[f"{flaw}_odds"] - model[flaw]["prior"] + log(own / (1 - own)))))
            assert abs(r[f"p_{flaw}"] - want) < 1e-5
