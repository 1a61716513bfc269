"""Mixing to target weights by soft membership: predicted domain posteriors, then document rates by projected gradient.

A domain is any column of a labelled table. The query mixes over ``lang``: in
these tables a text says nothing of its ``source``, so posteriors of sources
would be even and no rates could move their weights; give ``domain_col`` and
targets where texts do tell sources apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civilake.llm.langid import feature_rows, features
from civilake.llm.sampling import few, labelled_sample, unused
from civilake.llm.staging import staged

#: Most distinct labelled texts of one domain that the classifier is fitted on, and of all domains together.
ROWS_PER_DOMAIN, ROWS_IN_ALL = 400, 16_000
#: The class of labelled domains that have no target.
OTHER = ""
#: Share of the largest reachable budget that is asked for, so that no rate need stand at its bound.
HEADROOM = 0.98
# Production targets over the domains of the documents table, as shares of all tokens.
TARGETS = {"en": 0.55, "de": 0.175, "fr": 0.175, "es": 0.10}


class Softmax:
    """Multinomial logistic regression with class-balanced weights, by accelerated gradient steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: list[str], reg: float = 1e-4, steps: int = 300):
        self.classes = classes
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        target = np.eye(len(classes), dtype=np.float32)[y]
        share = (1 / np.maximum(target.sum(0), 1))[y] / len(classes)
        w = v = np.zeros((x.shape[1], len(classes)), np.float32)
        for step in range(steps):
            grad = x.T @ ((_softmax(x @ v) - target) * share[:, None]) + reg * v
            new = v - 1.0 * grad
            v = new + step / (step + 3) * (new - w)
            w = new
        self.w = w

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.w[:-1] + self.w[-1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(labelled: DataFrame, domains: list[str], text_col: str, domain_col: str, rows_per_domain: int = ROWS_PER_DOMAIN) -> Softmax | None:
    """Fit on at most ``rows_per_domain`` distinct texts of each domain, the lowest by hash; domains without a target are one class together.

    None if no labelled row of a wanted domain has a text.
    """
    label = F.when(F.col(domain_col).isin(domains), F.col(domain_col)).when(F.col(domain_col).isNotNull(), OTHER)
    body = F.when(F.length(text_col) > 0, F.col(text_col))
    x, found = feature_rows(labelled_sample(labelled, label, body, rows_per_domain, ROWS_IN_ALL))
    classes = sorted(set(found))
    return Softmax(x, np.searchsorted(classes, found), classes) if set(classes) - {OTHER} else None


def memberships(docs: DataFrame, model: Softmax | None, domains: list[str], id_col: str, text_col: str) -> DataFrame:
    """``id, n_tokens, p``: each row's word count and its posterior of each domain, in the order of ``domains``.

    What a posterior lacks to 1 belongs to domains without a target. A text
    without a word has no tokens and the same posterior for every learnt domain.
    Without a model all posteriors are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights a domain
    own = [i for i, c in enumerate(model.classes) if c in domains] if model else []
    at_domain = [domains.index(model.classes[i]) for i in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                p = np.zeros((len(texts), len(domains)))
                n = np.array([len((t or "").split()) for t in texts], np.int64)
                if own:
                    p[:, at_domain] = shared.value.posteriors(features(texts))[:, own]
                    p[np.ix_(np.flatnonzero(n == 0), at_domain)] = 1 / len(at_domain)
                yield pa.record_batch([part.column(0), pa.array(n), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["id", "n_tokens", "p"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, "id long, n_tokens long, p array<double>")


def rates_after(n: int, p: np.ndarray, first: float, steps: list[np.ndarray], most: float) -> np.ndarray:
    """The rates of ``n`` documents after these steps: each moves every rate along the document's posteriors and projects it to [0, most]."""
    rate = np.full(n, first)
    for step in steps:
        rate = np.clip(rate - p @ step, 0, most)
    return rate


def fit_rates(members: DataFrame, targets: np.ndarray, max_rate: float, budget: float | None = None, rounds: int = 40, tolerance: float = 1e-4) -> tuple[float, list[np.ndarray]]:
    """The starting rate and the steps of projected gradient descent on the squared errors of the domains' expected tokens.

    Each round sums the expected tokens of each domain over all documents (one
    number a domain reaches the driver) and steps along the residual, scaled by
    the inverse of the documents' second-moment matrix of posteriors (gradient
    descent in that metric). ``budget`` is the tokens wanted in all; unset, it is
    what the scarcest domain allows at ``max_rate``, less a little headroom.
    """
    k = len(targets)
    value = lambda i: F.element_at("p", i + 1)
    sums = members.agg(
        *(F.sum(F.col("n_tokens") * value(i)).alias(f"s{i}") for i in range(k)),
        *(F.sum(F.col("n_tokens") * value(i) * value(j)).alias(f"m{i}_{j}") for i in range(k) for j in range(k)),
    ).first()
    held = np.array([sums[f"s{i}"] or 0.0 for i in range(k)])
    moment = np.array([[sums[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    if held.sum() <= 0:
        return min(1.0, max_rate), []
    if budget is None:
        wanted = (targets > 0) & (held > 0)
        budget = HEADROOM * float((max_rate * held[wanted] / targets[wanted]).min()) if wanted.any() else held.sum()
    inverse = np.linalg.inv(moment + 1e-6 * held.sum() * np.eye(k))
    goal, first, steps = targets * budget, min(budget / held.sum(), max_rate), []
    best = (np.inf, 0)
    for _ in range(rounds):
        residual = _expected(members, first, steps, max_rate, k) - goal
        error = float(np.abs(residual).max() / budget)
        if error < best[0] * 0.999:
            best = (error, len(steps))
        elif len(steps) - best[1] >= 5:
            break
        if error < tolerance:
            break
        steps = [*steps, inverse @ residual]
    return first, steps[: best[1]]


def _expected(members: DataFrame, first: float, steps: list[np.ndarray], most: float, k: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            n = batch.column(0).to_numpy()
            p = batch.column(1).flatten().to_numpy().reshape(len(n), k)
            total += (n * rates_after(len(n), p, first, steps, most)) @ p
        yield pa.record_batch([pa.array(range(k), pa.int32()), pa.array(total)], names=["domain", "tokens"])

    found = members.select("n_tokens", "p").mapInArrow(run, "domain int, tokens double").groupBy("domain").agg(F.sum("tokens").alias("tokens"))
    out = np.zeros(k)
    for row in found.collect():  # a row for each domain
        out[row["domain"]] = row["tokens"]
    return out


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", max_rate: float = 1.0, budget: float | None = None) -> DataFrame:
    """``id, n_tokens, domain, rate, copies``: one row per input row.

    ``labelled`` (``text_col, domain_col``) teaches the classifier; null domains
    and empty texts teach nothing. ``domain`` is the likeliest of the targets, null
    where a domain without a target is likelier; such a text counts for no target.
    ``rate`` is the expected number of copies, in [0, max_rate]; ``copies`` is the
    rate rounded up or down by a hash of the id, so that it is right on average and
    the same in every run: realised weights scatter about the targets as tokens of
    single documents do. Null and empty texts have no tokens. Rows repeated with an
    id get one decision if their texts are equal. Without any labelled row of a
    targeted domain every rate is 1 and domain is null. An empty table gives no rows.
    """
    domains = sorted(targets)
    weights = np.array([max(targets[d], 0.0) for d in domains], float)
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(domains), 1 / len(domains))
    model = fit(labelled, domains, text_col, domain_col)
    members = staged(memberships(docs, model, domains, id_col, text_col), "mixing-members")
    first, steps = fit_rates(members, weights, max_rate, budget) if model else (1.0, [])
    k = len(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, k)
            rate = rates_after(batch.num_rows, p, first, steps, max_rate)
            likeliest = [domains[i] if p[row, i] > 1 - p[row].sum() else None for row, i in enumerate(p.argmax(1))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(likeliest, pa.string()), pa.array(rate)], names=["id", "n_tokens", "domain", "rate"])

    rated = members.select("id", "n_tokens", "p").mapInArrow(run, "id long, n_tokens long, domain string, rate double")
    chance = F.pmod(F.xxhash64("id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` itself mixed: each row as often as its ``copies`` say, with the columns of ``docs``.

    An id's decision is that of its row of most copies, whether ids are repeated or
    null (all null ids together, with the smallest 64-bit number). Only ids whose
    copies are not 1 are joined back; while they are few they are sent to the rows,
    so that texts stay where they are.
    """
    found = mix(docs, labelled, targets, id_col, **options)
    mark, times, copy = unused(docs, "__id"), unused(docs, "__copies"), unused(docs, "__copy")
    key = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    away = few(staged(found.groupBy(key(F.col("id")).alias(mark)).agg(F.max("copies").alias(times)).where(F.col(times) != 1), "mixing-decisions"))
    joined = docs.join(away, key(docs[id_col]) == away[mark], "left").where(F.coalesce(times, F.lit(1)) > 0)
    names = [F.col(f"`{n}`") for n in docs.columns]
    if options.get("max_rate", 1.0) <= 1.0:
        return joined.select(*names)
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1)))).alias(copy)).drop(copy)


def op4(docs: DataFrame) -> DataFrame:
    """The rows of query ``op4_mixing``: every document's expected and realised copies under the production targets."""
    return mix(docs, docs.where("lang IS NOT NULL"), TARGETS).withColumnRenamed("id", "doc_id")
