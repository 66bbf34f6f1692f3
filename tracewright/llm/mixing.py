"""Mixing to target weights with soft memberships, in DataFrame functions only.

A naive Bayes classifier, counted on a labelled table, gives each document a posterior over the domains. Rates are then
fitted so that the expected domain tokens (tokens x posterior x rate, summed) match the targets in least squares, by
projected gradient steps: each step is one aggregation over all documents, and a document's rate is a function of its
own posterior and the steps so far, so no rate ever has to be stored or sent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.sampling import least_hashed
from tracewright.session import stage

#: Buckets of word hashes; labelled rows of each domain that the classifier is fitted on.
BUCKETS, SAMPLE_ROWS = 4096, 2000
#: Words whose evidence a posterior rests on at most: longer texts count by their mean word.
EVIDENCE = 20.0
TEMPER = 0.7
#: Steps end when the miss is this small a share of all tokens, or hardly shrinks any more; else after so many.
TOLERANCE, STEPS = 1e-3, 60
#: Domains up to which steps use the Gram matrix; terms up to which a rate is one flat expression.
GRAM_DOMAINS, FEW_TERMS = 12, 256


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\S+)"), F.lit(1))


def _buckets(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))


def fit_classifier(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, log-prior, log-likelihood by bucket) from (doc_id, text, domain); rows without a domain teach nothing.

    At most `rows` ids a domain, those of least hash, are read (a parameter of the fit alone). All domains take part.
    What comes to the driver are counts: 4,096 buckets a domain.
    """
    known = labelled.where(F.col("domain").isNotNull() & F.col("text").isNotNull())
    shares = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return ["all"], np.zeros(1), np.zeros((1, BUCKETS))
    domains = sorted(shares)
    ids = least_hashed(known.where("doc_id is not null"), "domain", rows, shares)
    some = known.join(F.broadcast(ids), ["doc_id", "domain"], "left_semi").groupBy("domain", "doc_id").agg(F.min("text").alias("text"))
    counts = some.select("domain", F.explode(_buckets(F.col("text"))).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()
    table = np.full((len(domains), BUCKETS), 0.5)
    for r in counts:
        table[domains.index(r["domain"]), r["bucket"]] += r["n"]
    prior = np.log(np.array([shares[d] for d in domains], float) / sum(shares.values()))
    return domains, prior, np.log(table / table.sum(1, keepdims=True))


def with_posteriors(docs: DataFrame, prior: np.ndarray, table: np.ndarray) -> DataFrame:
    """Columns n_tokens and p (an array, one posterior a domain) beside the given ones, whose names do not begin with `_`."""
    k = len(prior)
    d = docs.withColumn("_b", _buckets(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    d = d.withColumn("n_tokens", F.size("_b").cast("long"))
    # one string literal a domain, folded into an array once
    logs = [F.split(F.lit(",".join(map(repr, table[i].tolist()))), ",").cast("array<double>") for i in range(k)]

    def total(row: Column) -> Column:
        return F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + F.coalesce(F.get(row, b), F.lit(0.0)))

    weight = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(EVIDENCE), F.col("n_tokens").cast("double"))), F.lit(0.0))
    d = d.withColumn("_s", F.array(*[F.lit(float(prior[i])) + weight * total(logs[i]) for i in range(k)]))
    d = d.withColumn("_top", F.array_max("_s"))
    d = d.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.col("_top"))))
    d = d.withColumn("_whole", F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x))
    return d.withColumn("p", F.transform("_e", lambda x: x / F.col("_whole"))).drop("_b", "_s", "_top", "_e", "_whole")


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def rate_column(steps: list[list[float]], least: float) -> Column:
    """A document's rate after the steps so far, as an expression over its posteriors `p`."""
    rate = F.lit(max(1.0, least))
    if sum(map(len, steps)) <= FEW_TERMS:
        for y in steps:
            move = sum((F.get("p", F.lit(i)) * F.lit(float(v)) for i, v in enumerate(y)), F.lit(0.0))
            rate = F.greatest(F.lit(float(least)), rate - move)
        return rate

    def one(r: Column, y: Column) -> Column:
        return F.greatest(F.lit(float(least)), r - F.aggregate(F.zip_with("p", y, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x))

    return F.aggregate(F.array(*map(_numbers, steps)), rate, one)


def fit_rates(memberships: DataFrame, targets: np.ndarray, least: float = 0.0, steps: int = STEPS) -> tuple[list[list[float]], float]:
    """Projected gradient steps until the expected domain totals match, and the last relative miss.

    memberships: n_tokens and p, stored (it is read once a step). The objective is the squared miss, each domain's
    weighed by its size. A step moves every rate against the gradient, a document's part divided by its tokens, and
    projects it onto [least, inf); so scaled, the Hessian is at most 1, and a full step never raises the objective. Up to
    GRAM_DOMAINS domains a faster step is tried first: the gradient is preconditioned by the Gram matrix of the documents
    that are above the bound. Steps end at TOLERANCE, when four plain ones in a row each take less than a twentieth off the
    objective (targets that no such rates meet are then met in least squares), or after `steps`.
    """
    k = len(targets)
    n, at = F.col("n_tokens").cast("double"), [F.get("p", F.lit(i)) for i in range(k)]
    size = np.maximum(_totals(memberships, k), 1e-9)
    scale = max(1.0, float(targets.sum()))
    pairs = [(i, j) for i in range(k) for j in range(i, k)] if k <= GRAM_DOMAINS else []

    def look(done: list[list[float]]) -> tuple[np.ndarray, float, np.ndarray | None]:
        """Miss, objective, and the Gram matrix of the free documents."""
        x = memberships.select("n_tokens", "p", rate_column(done, least).alias("r"))
        free = F.when(F.col("r") > least, n).otherwise(0.0)
        got = x.agg(*[F.sum(n * at[i] * F.col("r")) for i in range(k)], *[F.sum(free * at[i] * at[j]) for i, j in pairs]).first()
        e = np.array([v or 0.0 for v in got[:k]]) - targets
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:], strict=True):
            gram[i, j] = gram[j, i] = v or 0.0
        return e, float((e * e / size).sum()), gram if pairs else None

    done: list[list[float]] = []
    e, worth, gram = look(done)
    fast, slow = gram is not None, 0
    for _ in range(steps):
        if np.abs(e).max() <= TOLERANCE * scale or slow >= 4:
            break
        y = np.linalg.pinv(gram / scale + 1e-9 * np.eye(k)) @ (e / scale) if fast else e / size
        after = look([*done, y.tolist()])
        if fast and after[1] > 0.8 * worth:
            fast = False
            continue
        slow = 0 if fast or after[1] < 0.95 * worth else slow + 1
        done.append(y.tolist())
        e, worth, gram = after
    return done, float(np.abs(e).max() / scale)


def _totals(memberships: DataFrame, k: int) -> np.ndarray:
    """Expected tokens of each domain at rate 1."""
    got = memberships.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(k)]).first()
    return np.array([v or 0.0 for v in got])


def target_totals(weights: np.ndarray, totals: np.ndarray, whole: bool) -> np.ndarray:
    """Token targets for the weights: of the corpus' own size, or, if `whole`, so large that no domain has to shrink."""
    if not totals.sum():
        return totals
    if not whole:
        return weights * totals.sum()
    if (weights[totals > 0] <= 0).any():
        raise ValueError("a domain of weight 0 cannot keep its documents")
    return weights * (totals[totals > 0] / weights[totals > 0]).max()


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, whole: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate, copies and miss for each row; with `carry`, the whole row as the struct `row`.

    labelled: doc_id, text, domain; every domain in it takes part. weights: target share of each domain's tokens; by
    default the domains' shares to the power 0.7, made to sum to one. whole: upward mixing (rates are at least 1, so
    every document stays). copies is the rate rounded up or down by a hash of the id, so that its expectation is the
    rate. miss is the same in all rows: the largest distance of a domain's expected tokens from its target, as a share of
    all target tokens; it stays above the tolerance where no rates meet the targets, which are then met in least squares.

    Defined cases: a null text is empty: no tokens, posterior equal to the prior; without labelled rows there is one
    domain `all` and every rate is 1; a domain that weights does not name has weight 0; weights that name a domain
    without labelled rows, are negative, or (upward) are 0 for a domain that has tokens raise ValueError. Repeated rows
    get the same rate; a null doc_id rounds as any other id. Other columns are read only to carry them. An empty table
    gives no rows.
    """
    domains, prior, table = fit_classifier(labelled)
    if weights is not None and (any(w < 0 for w in weights.values()) or {x for x, w in weights.items() if w} - set(domains)):
        raise ValueError("weights are nonnegative and name domains that have labelled rows")
    k = len(domains)
    d = docs.select(*[F.struct("*").alias("row")] * carry, F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = with_posteriors(d, prior, table)
    stored = stage(members.select("doc_id", "n_tokens", "p"), "members")
    totals = _totals(stored, k)
    share = np.maximum(totals, 0.0) ** TEMPER if weights is None else np.array([weights.get(x, 0.0) for x in domains])
    share = share / share.sum() if share.sum() else np.full(k, 1.0 / k)
    least = 1.0 if whole else 0.0
    steps, miss = fit_rates(stored, target_totals(share, totals, whole), least)
    source = members if carry else stored
    unit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    out = source.withColumn("rate", rate_column(steps, least))
    return out.select(
        *["row"] * carry,
        "doc_id",
        "n_tokens",
        F.element_at(F.lit(domains), F.array_position("p", F.array_max("p")).cast("int")).alias("domain"),
        F.col("p").alias("posterior"),
        "rate",
        F.floor(F.col("rate") + unit).cast("int").alias("copies"),
        F.lit(miss).alias("miss"),
    )
