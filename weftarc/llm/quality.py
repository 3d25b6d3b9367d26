"""Quality of documents by hierarchical empirical Bayes.

A document has two flaws to be told: low quality, and toxic words. For each, a logistic regression on features of the
text gives the document's own evidence, as log odds. Sites form a hierarchy: all documents, hosts, and paths of a host.
The mean evidence of a site's documents, as probabilities, is its rate; a host's rate is shrunk toward the global one,
and a path's toward its host's, by a beta prior whose strength follows from the variance between sites by the method of
moments, so that a site with few documents has nearly the rate above it. The posterior of a document is its evidence
with the prior odds of the labelled sample replaced by those of its path.

Rates, strengths and posteriors take in all documents, through grouped aggregations. The regression is fitted on a
sample by hash of at most about ``SAMPLE`` labelled documents, on at most ``FEATURES`` features for each flaw, those
that differ most between the classes; both bounds are parameters.

Defined cases: a null or empty text has the one feature of being empty; labels that contradict each other count by
their mean; null labels are left out; without labels, or with labels of one class, all evidence is the prior's; a null
host or path is a site of its own; rows that repeat count as often as they come and get equal rows; a null id keeps its
row; further columns are ignored by judge(); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftarc.llm.common import arrow, slices, stored

SAMPLE, FEATURES, LEAST, SIGNIFICANT = 20_000, 400, 10, 5.0
FLAWS = ("low", "toxic")
BROADCAST = 100_000  # sites
WORDS, MARKS, LOUD, SPACES = re.compile(r"\w+"), re.compile(r"[^\w\s]+"), re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b"), re.compile(r"\s+")


def _levels(name: str, share: float) -> list[str]:
    """name<k for each k from 0 to 6 such that the share is at least 2^-k."""
    return [f"{name}<{k}" for k in range(7) if share >= 2.0**-k]


def features(text: str | None) -> set[str]:
    """Binary features of a text: words; shares of runs of punctuation and of words in capitals; size."""
    if not text or not text.strip():
        return {"empty"}
    words = WORDS.findall(text)
    n = max(1, len(text.split()))
    found = {w.lower() for w in words}
    for mark, k in Counter(MARKS.findall(text)).items():
        if len(mark) <= 4 and k >= 3:
            found.update(_levels(f"mark {mark}", k / n))
    found.update(_levels("loud", len(LOUD.findall(text)) / n))
    found.update(_levels("repeats", 1 - len(found) / max(1, len(words) + 8)))
    found.add(f"size {len(words).bit_length()}")
    return found


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, docs, low, toxic): in how many documents, and how many of each flaw."""
    counts: dict[str, list[int]] = {}

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3))], ["feature", "docs", *FLAWS])
        counts.clear()
        return out

    for b in slices(batches, "text"):
        for text, low, toxic in zip(*(b.column(c).to_pylist() for c in ("text", *FLAWS))):
            for f in features(text):
                c = counts.setdefault(f, [0, 0, 0])
                c[0] += 1
                c[1] += low > 0.5
                c[2] += toxic > 0.5
        if len(counts) > 200_000:
            yield rows()
    yield rows()


def _present(batches: Iterator[pa.RecordBatch], places: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The places of the chosen features that each text has."""
    wanted = frozenset(places)
    for b in slices(batches, "text"):
        found = [sorted(places[f] for f in features(t) & wanted) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32())), *(b.column(c) for c in FLAWS)], ["doc_id", "found", *FLAWS])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method with a ridge on the weights. x: booleans, taken a few rows at a time."""
    k = x.shape[1] + 1
    w, r = np.zeros(k), np.full(k, ridge)
    r[-1] = 1e-6
    for _ in range(steps):
        grad, curve = -r * w, np.diag(r)
        for i in range(0, len(x), 2048):
            part = np.ones((len(x[i : i + 2048]), k))
            part[:, :-1] = x[i : i + 2048]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            grad += part.T @ (y[i : i + 2048] - p)
            curve += (part * (p * (1 - p))[:, None]).T @ part
        change = np.linalg.solve(curve, grad)
        w += change * min(1.0, 4 / max(1e-9, np.abs(change).max()))
        if np.abs(change).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> dict[str, dict[str, float]]:
    """For each flaw, weights of features, with the bias under "" and the log odds of the sample under "prior"."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.avg("quality")).alias("low"), F.avg("toxic").alias("toxic")).dropna()
    total = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, total)))
    rows = stored(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known.filter(share)), "doc_id"), "labelled")  # about `sample` rows
    n, *flawed = rows.agg(F.count("*"), *(F.coalesce(F.sum((F.col(f) > 0.5).cast("long")), F.lit(0)) for f in FLAWS)).first()
    counted = arrow(_count_features, rows.select("text", *FLAWS), "feature string, docs long, low long, toxic long").groupBy("feature").agg(F.sum("docs").alias("docs"), *(F.sum(f).alias(f) for f in FLAWS))
    counted = counted.filter((F.col("docs") >= LEAST) & (F.col("docs") <= n - LEAST))
    chosen: dict[str, list[str]] = {}
    for flaw, k in zip(FLAWS, flawed):
        have, miss = F.col(flaw), F.col("docs") - F.col(flaw)
        p = F.col("docs") / F.lit(max(1, n))
        z = F.abs(have / max(1, k) - miss / max(1, n - k)) / F.sqrt(p * (1 - p) * (1 / max(1, k) + 1 / max(1, n - k)))
        chosen[flaw] = [r[0] for r in counted.withColumn("z", z).filter(F.col("z") > SIGNIFICANT).orderBy(F.desc("z"), "feature").limit(most).collect()] if 0 < k < n else []
    places = {f: i for i, f in enumerate(sorted({f for fs in chosen.values() for f in fs}))}
    got = arrow(_present, rows, "doc_id long, found array<int>, low double, toxic double", places).toArrow().combine_chunks()  # as many rows as the sample
    found = got.column("found").combine_chunks()
    have = np.zeros((got.num_rows, len(places)), bool)
    have[np.repeat(np.arange(got.num_rows), np.asarray(found.value_lengths())), np.asarray(found.flatten())] = True
    out = {}
    for flaw, k in zip(FLAWS, flawed):
        prior = float(np.log((k + 0.5) / (n - k + 0.5)))
        if not chosen[flaw]:
            out[flaw] = {"": prior, "prior": prior}
            continue
        y = np.asarray(got.column(flaw)) > 0.5
        x = have[:, [places[f] for f in chosen[flaw]]]
        order = np.lexsort((*x.T, y))  # sums in one order, however rows came
        w = np.round(_logistic(x[order], y[order].astype(float)), 9)
        out[flaw] = {f: float(v) for f, v in zip(chosen[flaw], w)} | {"": float(w[-1]), "prior": prior}
    return out


def _evidence(batches: Iterator[pa.RecordBatch], model: dict, text: str) -> Iterator[pa.RecordBatch]:
    """Rows with the log odds of each flaw; text: the column of texts, which is left out, or `row`, a struct that has it."""
    weights = [{f: w for f, w in model[flaw].items() if f not in ("", "prior")} for flaw in FLAWS]
    wanted = frozenset().union(*weights)
    for b in slices(batches, text):
        odds: list[list[float]] = [[], []]
        texts = b.column(text) if text == "text" else b.column(text).field("text")
        for t in texts.to_pylist():
            found = features(t) & wanted
            for o, w, flaw in zip(odds, weights, FLAWS):
                o.append(model[flaw][""] + sum(w.get(f, 0.0) for f in sorted(found)))
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in rest] + [pa.array(o, pa.float64()) for o in odds], rest + [f"{f}_odds" for f in FLAWS])


def _shrunk(sites: DataFrame, flaw: str, above: str) -> DataFrame:
    """sites with the column `{flaw}_rate`: the site's mean drawn to the column `above` by a prior of estimated strength.

    Of rates p_i over n_i documents around m_i, the variance between sites is that of the rates less what chance gives;
    a beta prior with that variance counts as m(1 - m) / variance - 1 documents, here between 1 and 10^6.
    """
    n, p, m = F.col("n"), F.col(f"{flaw}_sum") / F.col("n"), F.col(above)
    chance = m * (1 - m)
    # weighted by documents: sum n (p - m)^2 = sum of chance + variance * sum of n
    a = sites.agg(F.sum(n * (p - m) ** 2).alias("seen"), F.sum(chance).alias("chance"), F.sum(n).alias("n"), F.avg(chance).alias("mean")).first()
    between = max(0.0, (a["seen"] or 0.0) - (a["chance"] or 0.0)) / max(1, a["n"] or 1)
    strength = min(1e6, max(1.0, (a["mean"] or 0.25) / between - 1)) if between > 0 else 1e6
    return sites.withColumn(f"{flaw}_rate", (F.col(f"{flaw}_sum") + strength * m) / (n + strength))


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _sites(scored: DataFrame) -> DataFrame:
    """(h, p, low_rate, toxic_rate) of all paths of scored documents (host, path, low_odds, toxic_odds)."""
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(_probability(F.col(f"{f}_odds"))).alias(f"{f}_sum") for f in FLAWS)), "paths")
    sums = [F.sum(f"{f}_sum").alias(f"{f}_sum") for f in FLAWS]
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *sums)
    all_ = paths.agg(F.sum("n").alias("n"), *sums).first()
    for f in FLAWS:
        hosts = hosts.withColumn(f"{f}_all", F.lit((all_[f"{f}_sum"] or 0.0) / (all_["n"] or 1)))
        hosts = _shrunk(hosts, f, f"{f}_all")
    above = hosts.select(F.col("host").alias("h"), *(F.col(f"{f}_rate").alias(f"{f}_above") for f in FLAWS))
    sites = paths.join(above, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    for f in FLAWS:
        sites = _shrunk(sites, f, f"{f}_above")
    return stored(sites.select(F.col("host").alias("h"), F.col("path").alias("p"), *(f"{f}_rate" for f in FLAWS)), "sites")


def _posteriors(scored: DataFrame, sites: DataFrame, model: dict) -> DataFrame:
    """scored with p_low, p_toxic and keep. Sites are broadcast up to BROADCAST; beyond, they are joined by a shuffle."""
    few = sites.count() <= BROADCAST
    joined = scored.join(F.broadcast(sites) if few else sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    for f in FLAWS:
        rate = F.least(F.greatest(F.col(f"{f}_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
        joined = joined.withColumn(f"p_{f}", F.round(_probability(F.col(f"{f}_odds") - F.lit(model[f]["prior"]) + F.log(rate / (1 - rate))), 9))
    return joined.withColumn("keep", (F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5))


def _scored(docs: DataFrame, host: str, path: str, model: dict) -> DataFrame:
    chosen = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    return stored(arrow(_evidence, chosen, "doc_id long, host string, path string, low_odds double, toxic_odds double", model, "text"), "evidence")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: dict | None = None) -> DataFrame:
    """docs (doc_id, text, host, path) with p_low, p_toxic, and keep: whether both are at most one half."""
    model = model or fit(docs, labels)
    scored = _scored(docs, host, path, model)
    found = _posteriors(scored, _sites(scored), model)
    return found.select("doc_id", "host", "path", *(F.round(f"{f}_odds", 6).alias(f"{f}_odds") for f in FLAWS), *(f"p_{f}" for f in FLAWS), "keep")


def kept(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: dict | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; texts are read twice rather than shuffled."""
    model = model or fit(docs, labels)
    sites = _sites(_scored(docs, host, path, model))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    schema = StructType([*rows.schema.fields, *(StructField(f"{f}_odds", DoubleType()) for f in FLAWS)])
    return _posteriors(arrow(_evidence, rows, schema, model, "row"), sites, model).filter("keep").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
