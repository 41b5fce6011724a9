"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes model of hashed words, fitted to labelled rows, gives each document posteriors p over domains. Rates
least <= r <= most are fitted by projected gradient so that the expected token totals of the domains, sum of
r * tokens * p, are the targets' shares of the budget, in least squares; of equally good rates those nearest to 1 (a
penalty of `ridge` on their distance decides, and keeps the optimum single). Gradient steps add up before they are
projected, so a document's rate is one expression, r = min(most, max(least, 1 - p . sums)), and a step is the same few
numbers for every document, scaled by the inverse of the second moments of the documents off the bounds. Each
evaluation is one aggregate over a small table, and nothing but those sums reaches the driver. A step that doesn't
lower the dual of the problem is halved.

Edge cases: a null or empty text has the priors as posteriors and no tokens; without labels, or with one domain, rates
are equal; a domain of no expected tokens gives its target to the others; labels that are null take no part, and a
document with several labels counts for each; repeated rows are rated each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text, written

SPACE = r"[\x20\x09-\x0D]+"

#: The labelled table's domains.
DOMAINS = ("good", "poor", "toxic")


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def _words(texts: DataFrame) -> DataFrame:
    return texts.withColumn("w", F.filter(F.split(ascii_lower(F.col("text")), SPACE), lambda x: x != ""))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")


def classifier(docs: DataFrame, labels: DataFrame, domains=DOMAINS, per_class: int = 4000, buckets: int = 1 << 16, least_llr: float = 0.7, support: int = 5) -> tuple[DataFrame, list[float]]:
    """bucket and a log ratio l0.. for each domain (at most `buckets` rows), and the log priors.

    Fitted to at most per_class labelled rows of each domain, the first by a hash of the id.
    """
    known = labels.select(F.col("doc_id").alias("id"), domain_of().alias("domain")).dropna().distinct()
    shares = {r.domain: r.n for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for d in domains:
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    joined = docs.select(F.col("doc_id").alias("id"), whole_text().alias("text")).join(F.broadcast(chosen), "id")
    words = _words(joined).select("domain", F.explode_outer(F.array_distinct("w")).alias("word"))
    n = {r.domain: r.n for r in joined.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(n.values()))
    counts = words.dropna().groupBy(_bucket(buckets).alias("bucket")).agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)), F.count("*").alias("n"))
    rate = lambda k: (F.col(f"n{k}") + 0.5) / (n.get(domains[k], 0) + 1.0)
    mean = sum((rate(k) * (n.get(d, 0) / total) for k, d in enumerate(domains)), F.lit(0.0))
    ratio = lambda k: F.ln(rate(k) / mean)
    model = counts.where(F.col("n") >= support).select("bucket", *(F.when((F.abs(ratio(k)) >= least_llr) & F.lit(n.get(d, 0) > 0), ratio(k)).otherwise(0.0).alias(f"l{k}") for k, d in enumerate(domains)))
    all_n = sum(shares.get(d, 0) for d in domains)
    priors = [float(np.log(shares.get(d, 0) / all_n)) if shares.get(d, 0) and n.get(d, 0) else -1e9 for d in domains]
    return model, priors if any(p > -1e9 for p in priors) else [0.0] * len(domains)


def posteriors(docs: DataFrame, model: DataFrame, priors: list[float], buckets: int = 1 << 16) -> DataFrame:
    """row, doc_id, tokens, p0..: a row for each row of docs."""
    ks = range(len(priors))
    words = _words(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", whole_text().alias("text"))).select("row", "doc_id", F.size("w").cast("long").alias("tokens"), F.explode_outer(F.array_distinct("w")).alias("word"))
    hashed = words.select("row", "doc_id", "tokens", _bucket(buckets).alias("bucket"))
    sums = hashed.join(F.broadcast(model), "bucket", "left").groupBy("row", "doc_id", "tokens").agg(*(F.coalesce(F.sum(f"l{k}"), F.lit(0.0)).alias(f"s{k}") for k in ks))
    logit = [F.col(f"s{k}") + F.lit(priors[k]) for k in ks]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    e = [F.exp(x - top) for x in logit]
    return sums.select("row", "doc_id", "tokens", *((e[k] / sum(e[1:], e[0])).alias(f"p{k}") for k in ks))


def fit_rates(rated: DataFrame, targets: list[float], least: float = 0.0, growth: float = 1.0, steps: int = 60, most: float = float("inf"), ridge: float = 1e-6, tolerance: float = 1e-9) -> tuple[Column, dict]:
    """rated: tokens, p0... Returns the rate as an expression of p0.., and what was reached."""
    ks = range(len(targets))
    p = [F.col(f"p{k}") for k in ks]
    t = F.col("tokens").cast("double")
    first = rated.agg(F.sum(t).alias("w"), *(F.sum(t * p[k]).alias(f"t{k}") for k in ks)).first()
    words = first["w"] or 0.0
    one: Column = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.lit(1.0)))
    if not words:
        return one, {"totals": [0.0 for _ in ks], "error": 0.0, "steps": 0, "budget": 0.0, "settled": True}
    now = np.array([first[f"t{k}"] for k in ks])
    aim = np.array([max(0.0, x) if now[k] > 1e-9 * words else 0.0 for k, x in enumerate(targets)])
    aim = growth * (aim / aim.sum() if aim.sum() else now / now.sum())

    def free(sums: np.ndarray) -> Column:
        """The rate before its projection."""
        return F.lit(1.0) - sum((p[k] * float(sums[k]) for k in ks), F.lit(0.0))

    def rate(sums: np.ndarray) -> Column:
        return F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), free(sums)))

    def measured(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares of the tokens, second moments of the documents off the bounds, and the dual of the problem."""
        r, x = rate(sums), free(sums)
        off = F.when((x >= least) & (x <= most), t).otherwise(0.0)
        got = rated.agg(*(F.sum(t * p[k] * r).alias(f"t{k}") for k in ks), *(F.sum(off * p[a] * p[b]).alias(f"m{a}_{b}") for a in ks for b in ks[a:]), F.sum(t * (r * x - r * r / 2)).alias("d")).first()
        moments = np.array([[got[f"m{min(a, b)}_{max(a, b)}"] for b in ks] for a in ks]) / words
        return np.array([got[f"t{k}"] for k in ks]) / words, moments, got["d"] / words + float(aim @ sums) + ridge / 2 * float(sums @ sums)

    sums, done, settled = np.zeros(len(p)), 0, False
    share, moments, dual = measured(sums)
    while not settled and done < steps:
        slope = ridge * sums + aim - share
        if np.abs(slope).max() <= 1e-3 * tolerance:
            settled = True
            break
        way, size = -np.linalg.solve(moments + ridge * np.eye(len(p)), slope), 1.0
        while True:
            done += 1
            tried = measured(sums + size * way)
            if tried[2] <= dual + 1e-4 * size * float(slope @ way) or done >= steps:
                break
            size /= 2 if size > 1e-3 else 16
            if size < 1e-9:  # nothing that numbers can tell is left to gain
                settled = True
                break
        if not settled and tried[2] <= dual:
            sums = sums + size * way
            settled = dual - tried[2] < 1e-14 * max(1.0, abs(dual))
            share, moments, dual = tried
    error = float((((share - aim) / growth) ** 2).sum()) if growth else 0.0
    budget = words * growth
    return rate(sums), {"totals": (share * words).tolist(), "targets": (aim * words).tolist(), "error": error, "steps": done, "budget": budget, "settled": settled or error < tolerance}


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], least: float = 0.0, growth: float = 1.0, steps: int = 60, most: float = float("inf"), **how) -> DataFrame:
    """doc_id, tokens, a posterior p_<domain> for each domain, rate, error, settled: a row for each row of docs.

    error: the squared distance of the totals from the targets, in shares of the budget, the same in each row; settled:
    whether no step made it smaller (it is 0 where the targets can be met), rather than that `steps` ran out.
    """
    domains = tuple(targets)
    model, priors = classifier(docs, labels, domains, **how)
    rated = written(posteriors(docs, model, priors), "rated")
    rate, report = fit_rates(rated, list(targets.values()), least, growth, steps, most)
    return rated.select("doc_id", "tokens", *(F.round(f"p{k}", 9).alias(f"p_{d}") for k, d in enumerate(domains)), F.round(rate, 9).alias("rate"), F.lit(round(report["error"], 12)).alias("error"), F.lit(report["settled"]).alias("settled"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float = 1.1, most: float = 4.0, seed: int = 1) -> DataFrame:
    """docs with each row as often as its rate says, once at least: domains that are short are repeated, nothing is dropped.

    growth: the budget in shares of the tokens that there are; most: how often a row may be repeated. Rows of one id have the
    largest of their rates.
    """
    rates = mixing_rates(docs, labels, targets, least=1.0, growth=growth, most=most).groupBy(F.col("doc_id").alias("rated_id")).agg(F.max("rate").alias("rate"))
    rates = written(rates, "rates")
    rows = docs.toDF(*(f"__{c}" for c in docs.columns))  # so that no column of docs clashes
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("__doc_id")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = rows.join(rates, rows["__doc_id"].eqNullSafe(rates["rated_id"]), "left")
    repeats = F.sequence(F.lit(1), F.greatest(F.lit(1), F.coalesce(times, F.lit(1)).cast("int")))
    return out.withColumn("time", F.explode(repeats)).select(*rows.columns).toDF(*docs.columns)
