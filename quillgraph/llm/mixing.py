"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A naive Bayes classifier over hashed words and two shape features learns domains from the
labelled table and gives every document's domain posteriors. Rates (expected copies of each
document, not negative) then follow by projected gradient descent on the squared
errors of the expected domain token totals: r <- max(0, r - p' M (y - T)). The metric M is the inverse of
the Gram matrix of posteriors, sum n p p', over the documents with a rate over 0: where no rate is cut off at 0, one step meets the targets, however
much the domains overlap. A step that does not lessen the errors is halved; where that does not help, the step with M diagonal, 1 / max(N, T), is
taken, which cannot diverge: the totals' map has eigenvalues between 0 and 1.
Rates are a function of a document's posteriors and the steps so far, a few numbers
in a round; so no rate is stored or joined, a round is one sum of totals and Gram matrix over a narrow table, and the
result is computed where each document's posteriors are stored. Rounds end when every total is within ``tolerance`` of its
target, or no step lessens the errors any more: targets that no rates of 0 and more can meet.

The driver gets word-bucket counts by domain (``buckets`` at most for each) and one total
for each domain and round; nothing that grows with the documents.

Defined results: null or empty text has no tokens and the posteriors that its shape gives;
very long texts are taken whole; a document with several labels is in the worst of their
domains; labels with nulls only, or without a document, teach nothing, and without any the
posteriors are equal; a domain that no document belongs to cannot meet its target and is
left out; repeated rows get equal rates; an empty table gives no rows; other columns are kept
by ``mix`` and ignored by ``mixing_rates``.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, store


@dataclass(frozen=True)
class Mixture:
    """Target weights by domain; the domain ``anchor`` gets ``growth`` times its tokens, the others in proportion."""

    weights: dict[str, float]
    anchor: str
    growth: float = 1.2
    buckets: int = 16_384  # at most 2^15 - 22, as bucket numbers are kept in two bytes
    rounds: int = 40
    tolerance: float = 1e-4

    @property
    def domains(self) -> list[str]:
        return sorted(self.weights)


#: Clean text grows by a fifth; low and toxic text keep parts near a tenth and a hundredth of it. A choice, not a fit: any weights can stand here.
PRODUCTION = Mixture({"clean": 0.93, "low": 0.06, "toxic": 0.01}, anchor="clean")


def label_domain(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, domain`` from columns quality and toxic."""
    worst = labels.groupBy(id_col).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.coalesce("quality", "toxic").isNotNull(), "clean")
    return worst.select(id_col, domain.alias("domain")).where("domain is not null")


def _words(text: Column) -> Column:
    """Lower-cased, cut at spaces, tabs and line ends."""
    flat = F.lower(text)
    for space in "\n\t\r":
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


#: The signs that most of a text consists of, one by one, as Java's matcher looks these up in a table; none is a capital or a symbol.
COMMON = "[abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ0123456789 \n\t\r.,]+"


def _rare(text: Column) -> Column:
    """What is left of a text without its common signs: capitals, symbols and other scripts. One pass over the whole text."""
    return F.regexp_replace(text, COMMON, "")


def _buckets(words: Column, rare: Column, chars: Column, size: int) -> Column:
    """Distinct hashed words; two more buckets say how much of the text is capitals, and how much symbols."""
    share = lambda pattern: F.floor(10 * F.length(F.regexp_replace(rare, pattern, "")) / F.greatest(chars, F.lit(1))).cast("int")
    shape = F.array(F.lit(size) + share(r"[^A-ZÀ-Þ]+"), F.lit(size + 11) + share(r"[\p{L}\p{N}\s.,]+"))
    return F.concat(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("short"))), shape.cast("array<short>"))


def _constant(value) -> Column:
    """A constant array, folded once when the query is planned."""
    kind = "array<array<double>>" if value and isinstance(value[0], list) else "array<double>"
    return F.from_json(F.lit(json.dumps(value)), kind)


#: Posteriors of many hashed words are too sure; log odds count by this share.
SHARPNESS = 0.5
PULL = 20.0


def with_posteriors(df: DataFrame, model: list[list[float]], buckets_col: str, p_col: str) -> DataFrame:
    """Adds domain posteriors. model: for each domain, its log prior and then the log likelihood of each bucket."""
    def log_odds(prior: float, likelihood: list[float]) -> Column:
        table = _constant(likelihood)
        return F.aggregate(buckets_col, F.lit(prior), lambda s, b: s + F.element_at(table, b.cast("int") + 1))

    logs = [log_odds(prior, likelihood) for prior, *likelihood in model]
    raised = F.transform("logs_", lambda x: F.exp((x - F.array_max("logs_")) * SHARPNESS))
    normal = F.transform("e_", lambda x: x / F.aggregate("e_", F.lit(0.0), lambda s, y: s + y))
    return df.withColumn("logs_", F.array(*logs)).withColumn("e_", raised).withColumn(p_col, normal).drop("logs_", "e_")


def fit_domains(features: DataFrame, labels: DataFrame, mixture: Mixture, id_col: str = "doc_id") -> list[list[float]]:
    """Naive Bayes: for each domain its log prior, and the log of each bucket's part in all distinct buckets of its labelled documents.

    Parts are drawn towards those of all labelled documents, as if by ``PULL`` more documents,
    so that what a small domain has not shown says little.
    """
    # both may be large: shuffled at any size
    known = features.select(id_col, "buckets").join(labels.hint("shuffle_merge"), id_col)
    counts = known.select("domain", F.explode(F.concat("buckets", F.array(F.lit(-1).cast("short")))).alias("b")).groupBy("domain", "b").count().collect()
    by = {d: [0] * (mixture.buckets + 23) for d in mixture.domains}
    for domain, b, n in counts:
        if domain in by:
            by[domain][b + 1] = n
    documents, *seen = (sum(n) for n in zip(*by.values(), strict=True))
    whole = sum(seen)
    usual = [(n + 0.5) / (whole + 0.5 * len(seen)) for n in seen]
    pull = PULL * max(1.0, whole / max(1, documents))
    model = []
    for n, *shown in by.values():
        total = sum(shown) + pull
        model.append([math.log((n + 1) / (documents + len(by))), *[round(math.log((c + pull * u) / total), 6) for c, u in zip(shown, usual, strict=True)]])
    return model


def _rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate after the projected steps so far, from 1."""
    if not steps:
        return F.lit(1.0)
    dot = lambda s: F.aggregate(F.zip_with(s, p, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(_constant(steps), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small symmetric system, by elimination; a little is added to the diagonal, so that there is one."""
    k = len(right)
    rows = [[x + (1e-9 * (matrix[i][i] + 1e-9) if i == j else 0.0) for j, x in enumerate(matrix[i])] + [right[i]] for i in range(k)]
    for i in range(k):
        pivot = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for j in range(k):
            if j != i:
                share = rows[j][i] / rows[i][i]
                rows[j] = [x - share * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [rows[i][k] / rows[i][i] for i in range(k)]


def _descend(members: DataFrame, mixture: Mixture) -> tuple[list[list[float]], dict[str, float]]:
    """(steps for documents with tokens ``n`` and posteriors ``p``, each domain's expected total over its target)."""
    k = len(mixture.domains)

    def figures(steps: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """Expected totals, and the Gram matrix of the documents with a rate over 0."""
        rated = members.select("n", "p", _rate(F.col("p"), steps).alias("r"))
        held = F.when(F.col("r") > 0, F.col("n"))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = rated.agg(
            *[F.sum(F.col("r") * F.col("n") * F.col("p")[i]).alias(f"y{i}") for i in range(k)], *[F.sum(held * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i, j in pairs]
        ).first()
        gram = {(i, j): row[f"g{i}_{j}"] or 0.0 for i, j in pairs}
        return [row[f"y{i}"] or 0.0 for i in range(k)], [[gram[min(i, j), max(i, j)] for j in range(k)] for i in range(k)]

    base, gram = figures([])
    at = mixture.domains.index(mixture.anchor)
    whole = sum(mixture.weights.values())
    budget = mixture.growth * base[at] * whole / mixture.weights[mixture.anchor]
    target = [budget * mixture.weights[d] / whole for d in mixture.domains]
    known = [i for i in range(k) if base[i] > 0]
    error = lambda y: sum(((y[i] - target[i]) / max(base[i], target[i])) ** 2 for i in known)
    steps: list[list[float]] = []
    now = base
    for _ in range(mixture.rounds):
        if all(abs(now[i] - target[i]) <= mixture.tolerance * max(target[i], 1.0) for i in known):
            break
        part = _solved([[gram[i][j] for j in known] for i in known], [now[i] - target[i] for i in known])
        full = [0.0] * k
        for i, x in zip(known, part, strict=True):
            full[i] = x
        plain = [(now[i] - target[i]) / max(base[i], target[i]) if i in known else 0.0 for i in range(k)]
        for step in (full, [x / 2 for x in full], [x / 4 for x in full], plain):
            moved = figures([*steps, step])
            if error(moved[0]) < error(now) * 0.9999:
                break
        else:
            break  # as near as it gets
        steps.append(step)
        now, gram = moved
    return steps, {d: y / t for d, y, t, n in zip(mixture.domains, now, target, base, strict=True) if n > 0 and t > 0}


def fit_rates(members: DataFrame, mixture: Mixture) -> list[list[float]]:
    """Gradient steps for documents with tokens ``n`` and posteriors ``p``. Totals that end a hundredth off their targets or more are warned of."""
    steps, met = _descend(members, mixture)
    if off := {d: round(x, 4) for d, x in met.items() if abs(x - 1) >= 0.01}:
        warnings.warn(f"expected domain totals over their targets after {len(steps)} rounds: {off}", stacklevel=2)
    return steps


@dataclass(frozen=True)
class Fitted:
    """Everything that turns a text into its posteriors and rate."""

    mixture: Mixture
    model: list[list[float]]
    steps: list[list[float]]


def _features(docs: DataFrame, mixture: Mixture, text: Column) -> DataFrame:
    """Adds n_ and buckets_."""
    text = blank(text)
    # cuts and shapes first: the projection with array functions is not compiled
    split = docs.withColumns({"words_": _words(text), "rare_": _rare(text), "chars_": F.length(text)})
    made = {"n_": F.size("words_").cast("long"), "buckets_": _buckets(F.col("words_"), F.col("rare_"), F.col("chars_"), mixture.buckets)}
    return split.withColumns(made).drop("words_", "rare_", "chars_")


def _fit(features: DataFrame, labels: DataFrame, mixture: Mixture, id_col: str) -> tuple[Fitted, DataFrame]:
    """The fitted mixture, and ``id_col, n, p`` of every row, stored. features: id_col, n, buckets, stored."""
    model = fit_domains(features, label_domain(labels, id_col), mixture, id_col)
    members = store(with_posteriors(features, model, "buckets", "p").select(id_col, "n", "p"), "mixing-members")
    return Fitted(mixture, model, fit_rates(members, mixture)), members


def fit(docs: DataFrame, labels: DataFrame, mixture: Mixture = PRODUCTION, id_col: str = "doc_id", text_col: str = "text") -> tuple[Fitted, DataFrame]:
    """The fitted mixture, and ``id_col, n, p`` (tokens and domain posteriors) of every row."""
    rows = _features(docs.select(F.col(id_col), F.col(text_col).alias("text")), mixture, F.col("text"))
    features = store(rows.select(id_col, F.col("n_").alias("n"), F.col("buckets_").alias("buckets")), "mixing-features")
    return _fit(features, labels, mixture, id_col)


def mixing_rates(docs: DataFrame, labels: DataFrame, mixture: Mixture = PRODUCTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, p_<domain>..., rate`` of every row. A text is read once, its buckets once, its posteriors once for each round."""
    fitted, members = fit(docs, labels, mixture, id_col, text_col)
    return members.select(
        id_col,
        F.col("n").alias("n_tokens"),
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(mixture.domains)],
        _rate(F.col("p"), fitted.steps).alias("rate"),
    )


def mix(docs: DataFrame, labels: DataFrame, mixture: Mixture = PRODUCTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more with the rest as its chance (by hash)."""
    rows = _features(docs.select(F.struct(*docs.columns).alias("row_")), mixture, F.col("row_")[text_col])
    # rows are stored with their buckets, so that texts are cut once
    stored = store(rows, "mixing-rows")
    fitted, _ = _fit(stored.select(F.col("row_")[id_col].alias(id_col), F.col("n_").alias("n"), F.col("buckets_").alias("buckets")), labels, mixture, id_col)
    rate = _rate(F.col("p_"), fitted.steps)
    chance = F.pmod(F.xxhash64(F.col("row_")[id_col], F.col("row_")[text_col]), F.lit(1 << 20)) / float(1 << 20)
    # a row number keeps the filter on the copies above their computation; pushed below, it would repeat all of it for every step
    copies = with_posteriors(stored, fitted.model, "buckets_", "p_").select(
        "row_", F.floor(rate + chance).cast("int").alias("c_"), F.monotonically_increasing_id().alias("n_")
    )
    return copies.where("c_ > 0 and n_ >= 0").select("row_", F.explode(F.sequence(F.lit(1), "c_"))).select("row_.*")
