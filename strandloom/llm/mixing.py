"""Mixing to target weights with soft domain membership.

Domains are the classes of a labelled table. A multinomial naive Bayes classifier over
``BUCKETS`` hashed words, learned from every labelled document, gives each document a
posterior over domains (its mean log-likelihood counts as that of ``EFFECTIVE`` words,
so that long texts stay soft). Each document gets a rate of at least ``at_least``, fitted
by projected-gradient least squares so that the expected tokens of each domain, the sum of
tokens x posterior x rate, meet the targets. A step moves every rate against the gradient,
scaled by the inverse of the token overlap of the documents that are free to move, and cuts
it at the bound; of several lengths, the scaled and the plain direction, the best is taken. Steps
go on until the targets are met within ``tolerance`` or no step helps: ``fit_rates``
returns what is then still missing, and ``mix`` raises where that is over ``most_off`` if one is given.

Everything over documents is DataFrame work. Posteriors are rounded to ``1 / GRID``, and
documents of one rounded posterior are rated alike, so a step is an aggregate over at most
as many rows as the grid has points, however large the corpus; the driver sees sums per
domain and the bounded weight table only. Texts are never copied: posteriors are worked
out again in the result's own scan.

Defined results: a null or white text has 0 tokens and the prior as its posterior; its
rate follows its posterior like any other. Labels with a null in any label column are
ignored; an id labelled twice counts once per label. Without labels there is one
domain, ``all``. Targets for unknown domains are ignored; domains without target get 0;
if no target is left, or the table has no tokens, all rates are the larger of 1 and
``at_least``. Of domains with equal posteriors the first by name is ``domain``. Rows that repeat an id are rated alike
if their texts are. Columns named like a result column are replaced by ``mix``;
``repeat_rows`` of the pipeline keeps them, as it works on names of its own.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, let, quoted, table

RESULT = ("n_tokens", "domain", "posteriors", "rate", "copies")
BUCKETS, EFFECTIVE, SMOOTH = 4096, 24, 0.5
#: Posteriors are rounded to this part of 1.
GRID = 64
#: Without a total: what more of tokens the scarcest target gets than its documents' least, so that it can be met.
ROOM = 1.1
SPACE = r"[\x20\x09-\x0D]+"
#: Share of expected tokens that each domain (quality, toxic) shall have in the query.
TARGETS = {"q1t0": 0.70, "q0t0": 0.27, "q1t1": 0.02, "q0t1": 0.01}


def _words(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def label_domains(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(id, domain) rows, one domain for each pair of labels."""
    known = labels.where(quoted(id_col).isNotNull() & quoted(quality_col).isNotNull() & quoted(toxic_col).isNotNull())
    name = F.concat(F.lit("q"), quoted(quality_col).cast("string"), F.lit("t"), quoted(toxic_col).cast("string"))
    return known.select(quoted(id_col).alias("id"), name.alias("domain")).distinct()


def learn(docs: DataFrame, domains: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domain names, log priors, log weights of each domain's buckets)."""
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    buckets = F.transform(_words(F.col("text")), lambda w: _bucket(w).cast("smallint")).alias("buckets")
    domains = scratch.write(domains, "domains")
    if domains.count() * 64 <= BROADCAST_BYTES:  # labelled texts are found in the scan
        met = texts.join(F.broadcast(domains), "id").select("domain", buckets)
    else:  # hashed words are shuffled, not texts
        met = texts.select("id", buckets).join(domains, "id")
    each = met.select("domain", F.explode_outer("buckets").alias("bucket"))
    counts = scratch.write(each.groupBy("domain", "bucket").count(), "counts")
    per_domain = domains.groupBy("domain").count().orderBy("domain").collect()
    names = [r.domain for r in per_domain]
    if not names:
        return ["all"], np.zeros(1), np.zeros((1, BUCKETS))
    at = {d: k for k, d in enumerate(names)}
    weights = np.full((len(names), BUCKETS), SMOOTH)
    for r in counts.where("bucket IS NOT NULL").collect():  # at most domains x BUCKETS rows
        weights[at[r.domain], r.bucket] += r["count"]
    prior = np.array([r["count"] for r in per_domain], dtype=float)
    return names, np.log(prior / prior.sum()), np.log(weights / weights.sum(axis=1, keepdims=True))


def _adding(weights):
    return lambda total, bucket: total + F.get(weights, bucket)


def with_posteriors(docs: DataFrame, names: list[str], prior: np.ndarray, weights: np.ndarray, text_col: str = "text"):
    """A struct column (n, p): number of words, and posteriors in the order of ``names``."""
    k = len(names)
    # weights against the first domain, as one literal array per other domain
    tables = [F.from_json(F.lit(json.dumps([round(float(x), 5) for x in weights[j] - weights[0]])), "array<double>") for j in range(1, k)]

    def posterior(words):
        n = F.size(words)
        hashed = F.transform(words, _bucket)

        def scored(buckets):
            means = [F.aggregate(buckets, F.lit(0.0), _adding(t)) / F.greatest(n, F.lit(1)) for t in tables]
            logits = [F.lit(float(prior[0]))] + [m * F.least(n, F.lit(EFFECTIVE)) + float(prior[j + 1]) for j, m in enumerate(means)]
            odds = [F.exp(F.least(x - logits[0], F.lit(500.0))) for x in logits]
            return let(F.array(*odds), lambda o: F.transform(o, lambda x: x / F.aggregate(o, F.lit(0.0), lambda a, y: a + y)))

        return F.struct(n.cast("long").alias("n"), let(hashed, scored).alias("p"))

    return let(_words(quoted(text_col)), posterior)


def rounded(p, k: int):
    """Posteriors as whole numbers of ``1 / GRID``: the first takes what the others leave, so that they sum to one."""
    others = [F.round(F.get(p, F.lit(j)) * GRID).cast("int") for j in range(1, k)]
    return F.array(F.lit(GRID) - sum(others, F.lit(0)), *others)


def fit_rates(bins: DataFrame, targets: np.ndarray, total: float | None = 1.0, at_least: float = 0.0, tolerance: float = 1e-4, steps: int = 60) -> tuple[list[list[float]], list[dict]]:
    """The pushes of all steps, from which ``rate_of`` gives a bin's rate; and what each step saw.

    ``bins``: n (tokens), p (posteriors), one row for each point of the grid. ``targets``
    are shares of ``total`` times the present tokens; without ``total`` of as many tokens
    as the documents need, at their least rates, to reach the scarcest target.
    """
    k = len(targets)
    p = [F.get("p", F.lit(j)) for j in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    pushes, log = [], []
    start = max(1.0, float(at_least))
    here = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(F.col("n") * p[j]).alias(f"e{j}") for j in range(k)]).first()
    tokens = float(here.n)
    if not tokens or not targets.sum():
        return pushes, log
    goal = targets / targets.sum()
    if total is None:
        present = np.array([here[f"e{j}"] for j in range(k)]) / tokens
        total = ROOM * max([1.0, *(start * present[goal > 0] / goal[goal > 0])])
    goal = goal * total

    rate = lambda moves: rate_of(F.col("p"), moves, at_least)

    def missing(tries: list[list[list[float]]]) -> list[np.ndarray]:
        """What the expected tokens are off after each list of moves."""
        rated = bins.select("n", "p", *[rate(moves).alias(f"r{t}") for t, moves in enumerate(tries)])
        got = rated.agg(*[F.sum(F.col("n") * p[j] * F.col(f"r{t}")).alias(f"e{t}_{j}") for t in range(len(tries)) for j in range(k)]).first()
        return [np.array([got[f"e{t}_{j}"] for j in range(k)]) / tokens - goal for t in range(len(tries))]

    def overlap(moves: list[list[float]], off: np.ndarray) -> np.ndarray:
        """The token overlap of the documents that the gradient moves: above the bound, or pushed up from it."""
        up = sum((p[j] * float(off[j]) for j in range(1, k)), p[0] * float(off[0])) < 0
        got = bins.where((rate(moves) > at_least) | up).agg(*[F.coalesce(F.sum(F.col("n") * p[i] * p[j]), F.lit(0.0)).alias(f"h{i}_{j}") for i, j in pairs]).first()
        out = np.zeros((k, k))
        for i, j in pairs:
            out[i, j] = out[j, i] = got[f"h{i}_{j}"] / tokens
        return out

    [off] = missing([pushes])
    for step in range(steps):
        log.append({"step": step, "off": off.tolist()})
        if np.abs(off).max() <= tolerance:
            break
        free = overlap(pushes, off)
        scaled = [np.linalg.solve(free + damp * np.eye(k), off) for damp in (1e-4, 1e-3, 1e-2)]
        plain = off / max(float(np.linalg.eigvalsh(free).max()), 1e-9)
        tries = [[*pushes, [float(x) for x in length * push]] for push in (*scaled, plain) for length in (2.0, 1.0, 0.4)]
        after = missing(tries)
        best = int(np.argmin([(x**2).sum() for x in after]))
        if (after[best] ** 2).sum() > (off**2).sum() * (1 - 1e-2):  # a standstill
            break
        pushes, off = tries[best], after[best]
    else:
        log.append({"step": steps, "off": off.tolist()})
    return pushes, log


def rate_of(p, pushes: list[list[float]], at_least: float = 0.0):
    """The rate of a document with posteriors ``p``: 1, moved by each push and cut at ``at_least`` in turn."""
    moves = F.from_json(F.lit(json.dumps(pushes)), "array<array<double>>")
    slope = lambda push: F.aggregate(F.zip_with(p, push, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return F.aggregate(moves, F.lit(max(1.0, float(at_least))), lambda rate, push: F.greatest(F.lit(float(at_least)), rate - slope(push)))


def _fitted(docs: DataFrame, domains: DataFrame, targets: dict[str, float], text_col: str, id_col: str, total: float | None, at_least: int, most_off: float | None):
    """(names, function from a struct of n and p to one of n, p, rate) of the corpus."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names, prior, weights = learn(docs, domains, scratch, text_col, id_col)
    k = len(names)
    judged = with_posteriors(docs, names, prior, weights, text_col)
    grid = docs.select(judged.alias("m")).select(F.col("m.n").alias("n"), rounded(F.col("m.p"), k).alias("g"))
    bins = grid.groupBy("g").agg(F.sum("n").alias("n")).select("n", F.transform("g", lambda x: x / F.lit(GRID)).alias("p"))
    bins = scratch.write(bins.coalesce(1), "bins")  # at most as many rows as the grid has points
    pushes, log = fit_rates(bins, np.array([max(0.0, targets.get(d, 0.0)) for d in names]), total, at_least)
    if most_off is not None and log and max(map(abs, log[-1]["off"])) > most_off:
        raise ValueError(f"the targets cannot be met: expected tokens stay off by {log[-1]['off']}")
    return names, judged, pushes


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id", total: float | None = 1.0, at_least: int = 0, carry: list[str] | None = None, most_off: float | None = None, as_struct: str | None = None) -> DataFrame:
    """Every row (its ``carry`` columns, all by default) with the RESULT columns.

    ``copies`` is the rate rounded up or down by a hash of the id, so that its expected
    value is the rate; rates are at least ``at_least``, which the fit knows. With
    ``as_struct`` the RESULT columns are fields of a column of that name, and all input
    columns stay, whatever their names.
    """
    names, judged, pushes = _fitted(docs, domains, targets, text_col, id_col, total, at_least, most_off)
    k = len(names)
    even = F.pmod(F.xxhash64(F.lit("mix"), quoted(id_col)), F.lit(1_000_000)) / 1_000_000
    best = lambda p: F.get(F.array(*[F.lit(d) for d in names]), (F.array_position(p, F.array_max(p)) - 1).cast("int"))

    def result(m):
        grid = F.transform(rounded(m.p, k), lambda x: x / F.lit(GRID))
        return let(rate_of(grid, pushes, at_least), lambda rate: F.struct(m.n.alias("n_tokens"), best(m.p).alias("domain"), m.p.alias("posteriors"), rate.alias("rate"), F.floor(rate + even).cast("long").alias("copies")))

    mixed = let(judged, result)
    if as_struct is not None:
        return docs.select("*", mixed.alias(as_struct))
    taken = {x.casefold() for x in RESULT}
    kept = [c for c in (docs.columns if carry is None else carry) if c.casefold() not in taken]
    out = docs.select(F.struct(*[quoted(c) for c in kept]).alias("__row") if kept else F.lit(0).alias("__row"), mixed.alias("__m"))
    return out.select(*(["__row.*"] if kept else []), *[F.col(f"__m.{c}").alias(c) for c in RESULT])


def repeat_rows(docs: DataFrame, domains: DataFrame, targets: dict[str, float], text_col: str = "text", id_col: str = "doc_id", total: float | None = 1.0, at_least: int = 0) -> DataFrame:
    """Each row of ``docs`` as often as ``mix`` says, with all of its own columns and no others."""
    own = f"__mix_{uuid.uuid4().hex[:8]}"
    mixed = mix(docs, domains, targets, text_col, id_col, total, at_least, as_struct=own)
    times = F.col(f"{own}.copies")
    each = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))
    return mixed.withColumn(own, F.explode(each)).drop(own)


def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS, carry=["doc_id"])
    return mixed.select("doc_id", "n_tokens", "domain", F.round(F.array_max("posteriors"), 9).alias("posterior"), F.round("rate", 9).alias("rate"), "copies")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
