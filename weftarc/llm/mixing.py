"""Mixing of domains to target token weights by soft membership, in SQL functions.

A naive Bayes classifier over hashed words, fitted on a table of labelled documents, gives every document posteriors p_k
of the domains. Each document d of n_d tokens gets a rate r_d, at least ``floor``, so that the expected tokens of the
domains, S_k = sum of r_d * n_d * p_dk, come as near to their targets T_k as least squares can. That is solved by
projected gradient steps from r = 1, scaled by the Gram matrix G_kl = sum of n_d * p_dk * p_dl over documents that are
free to move: all r_d change by the inner product of p_d with one vector, and are cut off at the floor. A document's rate
is thus a function of its posteriors and of the vectors so far, which are all the state there is; a step is one
aggregation over all documents, and only sums of a row for each domain pair come to the driver.

Copies are whole numbers: the rate's floor, and one more for those whose hash falls under its fraction, so that the
expected number is the rate.

The classifier is fitted on a sample by hash of about ``SAMPLE`` labelled documents at most; every label
is a domain. Weights of domains that no document is labelled with are an error, if there are labels. Posteriors are flattened: evidence of more than ``SOFT`` words counts as that of so many.

Defined cases: a null or empty text has no tokens, the prior as posterior, and the floor or 1 as rate, whichever is
higher; null labels are left out; without labels there is one domain, "all"; rows that repeat get equal rows; a null id
counts as any other; further columns are kept by mixed(); an empty table gives no rows; a domain without tokens that
could reach its target leaves the rest of it unmet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import SPACE, ascii_lower, stored

SAMPLE, BUCKETS, SOFT, SMOOTH = 20_000, 4096, 40, 0.5
STEPS, CLOSE = 40, 1e-10


def _words(text: str = "text") -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SPACE), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, their prior log odds, and log weights of hashed words (domain, bucket), from labelled (doc_id, domain)."""
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "domain").dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    shares = known.groupBy("domain").count().collect()  # a row for each domain
    if not shares:
        return ["all"], np.zeros(1), np.zeros((1, BUCKETS))
    domains = sorted(r["domain"] for r in shares)
    total = sum(r["count"] for r in shares)
    part = F.pmod(F.xxhash64("doc_id", F.lit("domain")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / total))
    chosen = known.filter(part)  # about `sample` rows
    words = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("domain", F.explode(_words()).alias("word"))
    counts = np.zeros((len(domains), BUCKETS))
    for r in words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).count().collect():  # at most BUCKETS rows for each domain
        counts[domains.index(r["domain"]), r["bucket"]] = r["count"]
    weights = np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    prior = np.log([next(r["count"] for r in shares if r["domain"] == d) / total for d in domains])
    return domains, prior, weights - weights.mean(axis=0)


def _total(weights: np.ndarray) -> Column:
    """The sum over the buckets `at` of their weights, which are one constant array of the plan."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in weights)), ",").cast("array<double>")
    return F.aggregate("at", F.lit(0.0), lambda total, i: total + F.get(table, i))


def posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_tokens, p_0, p_1, ...)."""
    domains, prior, weights = model
    buckets = docs.select(F.col("doc_id").cast("long"), F.transform(_words(), _bucket).alias("at"))
    n = F.size("at")
    odds = buckets.select("doc_id", n.cast("long").alias("n_tokens"), *(_total(w).alias(f"e_{k}") for k, w in enumerate(weights)))
    flat = F.when(F.col("n_tokens") > SOFT, SOFT / F.col("n_tokens")).otherwise(F.lit(1.0))
    odds = odds.select("doc_id", "n_tokens", *((F.col(f"e_{k}") * flat + float(p)).alias(f"e_{k}") for k, p in enumerate(prior)))
    names = [f"e_{k}" for k in range(len(domains))]
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    odds = odds.withColumn("top", top).select("doc_id", "n_tokens", *(F.exp(F.col(e) - F.col("top")).alias(e) for e in names))
    sum_ = sum((F.col(e) for e in names[1:]), F.col(names[0]))
    return odds.select("doc_id", "n_tokens", *((F.col(e) / sum_).alias(f"p_{k}") for k, e in enumerate(names)))


def _rate(history: list[np.ndarray], floor: float) -> Column:
    r = F.lit(max(1.0, floor))
    for step in history:
        move = sum((F.col(f"p_{k}") * float(x) for k, x in enumerate(step)), F.lit(0.0))
        r = F.greatest(F.lit(floor), r + move)
    return r


def solve(table: DataFrame, k: int, targets: np.ndarray, floor: float = 0.0, steps: int = STEPS) -> list[np.ndarray]:
    """The vectors of the steps that bring expected tokens of a table of posteriors to the targets."""
    history: list[np.ndarray] = []
    best = None
    scale = 1.0
    for _ in range(steps):
        rated = table.withColumn("r", _rate(history, floor))
        n = F.col("n_tokens")
        free = F.when(F.col("r") > floor, n).otherwise(F.lit(0))
        sums = [F.sum(n * F.col("r") * F.col(f"p_{i}")).alias(f"s_{i}") for i in range(k)]
        gram = [F.sum(w * F.col(f"p_{i}") * F.col(f"p_{j}")).alias(f"{name}_{i}_{j}") for name, w in (("g", free), ("h", n)) for i in range(k) for j in range(i, k)]
        row = rated.agg(*sums, *gram).first().asDict()
        lack = targets - np.array([row[f"s_{i}"] or 0.0 for i in range(k)])
        size = float(np.linalg.norm(lack / np.maximum(targets, 1.0)))
        if best is not None and size >= best[0]:
            # too far: half the last step, from where it began
            history, scale = best[1][:], scale / 2
            if scale < 1e-3:
                break
            history.append(best[2] * scale)
            continue
        matrix = np.zeros((k, k))
        name = "g" if (row["g_0_0"] or 0.0) > 0 else "h"
        for i in range(k):
            for j in range(i, k):
                matrix[i, j] = matrix[j, i] = row[f"{name}_{i}_{j}"] or 0.0
        step = np.linalg.lstsq(matrix + np.eye(k) * 1e-12 * max(1.0, np.trace(matrix)), lack, rcond=None)[0]
        best, scale = (size, history[:], step), 1.0
        if size < CLOSE:
            break
        history.append(step)
    return best[1] if best and scale < 1e-3 else history


def tempered(sums: np.ndarray, power: float) -> np.ndarray:
    w = (np.maximum(sums, 0) / max(sums.sum(), 1e-9)) ** power
    return w / max(w.sum(), 1e-9)


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | float = 0.0, floor: float = 0.0, grow: bool = False) -> tuple[DataFrame, list[str]]:
    """docs (doc_id, text) as (doc_id, n_tokens, p_<domain> ..., rate, copies), and the domains.

    weights: of the domains, or a power of their natural shares (0: equal). The targets' total is that of all tokens;
    with grow, as many as it takes for no target to be below its domain's natural total.
    """
    model = fit(docs, labelled)
    domains = model[0]
    k = len(domains)
    if isinstance(weights, dict) and domains != ["all"] and (unknown := sorted(set(weights) - set(domains))):
        raise ValueError(f"weights of domains that no document is labelled with: {unknown}")
    table = stored(posteriors(docs, model), "posteriors")
    first = table.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{i}")), F.lit(0.0)) for i in range(k))).first()
    sums = np.array([float(x) for x in first])
    share = tempered(sums, weights) if isinstance(weights, float) else np.array([weights.get(d, 0.0) for d in domains])
    share = share / max(share.sum(), 1e-9)
    total = max(sums.sum(), *(s / w for s, w in zip(sums, share) if w > 0)) if grow and share.any() else sums.sum()
    history = solve(table, k, share * total, floor)
    rated = table.withColumn("rate", F.when(F.col("n_tokens") > 0, _rate(history, floor)).otherwise(F.lit(max(1.0, floor))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 32)) / float(1 << 32)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("long")
    return rated.select("doc_id", "n_tokens", *(F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", copies.alias("copies")), domains


def by_language(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries here: the language of the documents that have labels."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return mix(docs, by_language(docs, labels))[0]
