"""Toxicity categories by a chain of linear models over words and word beginnings.

Categories are predicted in order; the model of each gets the probabilities of all before it as further
inputs. In training these come out of fold: every row's probability is from models that have not seen
the row, neither for their weights nor for choosing their features, so that later models learn how far
earlier ones can be trusted.

A bounded sample of labelled rows trains the chain. Spark counts every feature of the sample's texts by
fold and label; features that stand out come to the driver, with which of them each sampled row has.
Prediction reads every text whole, in one map.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map, slices
from lectern.session import pin

TOKEN = re.compile(r"\w+|[^\w\s]+")
PREFIXES = (4, 5, 6, 7)
FOLDS = 5
CACHE = 400_000


def features(word: str) -> list[int]:
    """Hashes of a token and of its beginnings."""
    names = [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(n) - (1 << 63) for n in names]


def feature_arrays(texts: Iterable[str | None]) -> Iterable[np.ndarray]:
    """The distinct features of each text."""
    cache: dict[str, list[int]] = {}
    for text in texts:
        if len(cache) > CACHE:
            cache.clear()
        found: set[int] = set()
        for word in set(TOKEN.findall((text or "").lower())):
            known = cache.get(word)
            if known is None:
                known = cache[word] = features(word)
            found.update(known)
        yield np.fromiter(found, dtype=np.int64, count=len(found))


@dataclass(frozen=True)
class Linear:
    """Weights of chosen features, of the earlier categories' log odds, and the constant."""

    chosen: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def odds(self, row: np.ndarray, column: np.ndarray, size: int, earlier: np.ndarray) -> np.ndarray:
        """Log odds of ``size`` rows whose features are (row, column) pairs."""
        return np.bincount(row, self.weights[column], size) + earlier @ self.earlier + self.constant


def train_linear(
    row: np.ndarray, column: np.ndarray, n_features: int, earlier: np.ndarray, y: np.ndarray, penalty: float = 2.0, steps: int = 120
) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L2 penalty, by full-batch Adam."""
    n, k = len(y), earlier.shape[1]
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    theta = np.zeros(n_features + k + 1)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        odds = np.bincount(row, theta[column], n) + earlier @ theta[n_features:-1] + theta[-1]
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
        slope = np.concatenate([np.bincount(column, error[row], n_features), earlier.T @ error, [error.sum()]])
        slope[:-1] += penalty * theta[:-1]
        slope /= n
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features:-1], float(theta[-1])


def standing_out(with_feature: np.ndarray, positive: np.ndarray, n: float, n_positive: float, least: float) -> np.ndarray:
    """Features whose count among positives is ``least`` deviations off what their frequency implies."""
    share = n_positive / max(n, 1)
    spread = np.sqrt(with_feature * share * (1 - share) + 1)
    return (with_feature >= 3) & (np.abs(positive - with_feature * share) >= least * spread)


@dataclass(frozen=True)
class Chain:
    """Models in order, over one sorted array of features."""

    categories: tuple[str, ...]
    features: np.ndarray
    models: tuple[Linear, ...]

    def probabilities(self, row: np.ndarray, column: np.ndarray, size: int) -> np.ndarray:
        odds = np.zeros((size, 0))
        for model in self.models:
            odds = np.column_stack([odds, np.clip(model.odds(row, column, size, odds), -30, 30)])
        return 1 / (1 + np.exp(-odds))


def fit_chain(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, str, int]],
    doc_id: str = "doc_id",
    text: str = "text",
    sample: int = 20_000,
    most_features: int = 1_024,
    least_deviation: float = 4.0,
) -> Chain:
    """A chain for ``categories``: (name, column of ``labels``, value that means yes), in chain order.

    About ``sample`` labelled ids are drawn by hash, and each category's model has at most ``most_features``
    features, those that deviate most. A null label is no training row for its category; a
    category without both answers gets a constant model. Ids with several labels count as yes if any
    says so. Labelled rows without a document, or with a null id, are no training rows.
    """
    names = tuple(name for name, _, _ in categories)
    answers = labels.where(labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("doc_id")).agg(
        *[F.max((labels[column] == value).cast("int")).alias(f"y{i}") for i, (_, column, value) in enumerate(categories)]
    )
    count = answers.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(count, 1)))
    # At most about ``sample`` ids, however many labels there are.
    drawn = pin(answers.where(draw).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLDS)).cast("int")))
    codes = [f"y{i}" for i in range(len(categories))]
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(drawn), "doc_id")

    def count_features(batches: Batches) -> Iterable[dict]:
        for whole in batches:
            for batch in slices(whole, chars=2_000_000):
                found = list(feature_arrays(batch.column("text").to_pylist()))
                if not found:
                    continue
                owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
                values, place = np.unique(np.concatenate(found), return_inverse=True)
                fold = batch.column("fold").to_numpy()[owner]
                counts = {"feature": values}
                for i, code in enumerate(codes):
                    y = batch.column(code).fill_null(-1).to_numpy()[owner]
                    for part in range(FOLDS):
                        for j, wanted in enumerate((y >= 0, y == 1)):
                            name = f"c{(i * FOLDS + part) * 2 + j}"
                            counts[name] = np.bincount(place[(fold == part) & wanted], minlength=len(values))
                yield counts

    width = len(codes) * FOLDS * 2
    schema = "feature bigint, " + ", ".join(f"c{i} int" for i in range(width))
    seen = arrow_map(rows.select("text", "fold", *codes), count_features, schema)
    counted = seen.groupBy("feature").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])
    size = pin(drawn.groupBy("fold").agg(*[f(c).alias(f"{n}{c}") for c in codes for n, f in (("n", F.count), ("p", F.sum))])).collect()
    totals = np.zeros((len(codes), FOLDS, 2))
    for r in size:
        for i, c in enumerate(codes):
            totals[i, r["fold"]] = (r[f"n{c}"], r[f"p{c}"] or 0)

    def deviation(i: int):
        base = i * FOLDS * 2
        d = sum((F.col(f"c{base + 2 * f}") for f in range(FOLDS)), F.lit(0))
        c = sum((F.col(f"c{base + 2 * f + 1}") for f in range(FOLDS)), F.lit(0))
        share = float(totals[i, :, 1].sum() / max(totals[i, :, 0].sum(), 1))
        return F.when(d >= 3, F.abs(c - d * share) / F.sqrt(d * share * (1 - share) + 1)).otherwise(0.0)

    # Slightly below the least deviation, since leaving a fold out can raise it.
    floor = 0.8 * least_deviation
    measured = counted.withColumns({f"z{i}": deviation(i) for i in range(len(codes))})
    measured = pin(measured.where(F.greatest(*[F.col(f"z{i}") for i in range(len(codes))], F.lit(0.0)) >= floor))
    picked = [
        measured.where(F.col(f"z{i}") >= floor).orderBy(F.desc(f"z{i}"), "feature").limit(most_features).collect()
        for i in range(len(codes))
    ]
    best = sorted({r["feature"]: r for rows_of in picked for r in rows_of}.values(), key=lambda r: r["feature"])
    own = [{r["feature"] for r in rows_of} for rows_of in picked]
    known = np.array([r["feature"] for r in best], dtype=np.int64)
    table = np.array([[r[f"c{j}"] for j in range(width)] for r in best], dtype=float).reshape(len(best), len(codes), FOLDS, 2)

    def pick(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            held = []
            for found in feature_arrays(batch.column("text").to_pylist()):
                at = np.searchsorted(known, found)
                held.append(np.sort(at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == found)]) if len(known) else at[:0])
            yield {c: batch.column(c) for c in ("fold", *codes)} | {"held": [h.astype(np.int32).tobytes() for h in held]}

    schema = "fold int, " + ", ".join(f"{c} int" for c in codes) + ", held binary"
    data = arrow_map(rows.select("text", "fold", *codes), pick, schema).collect()
    held = [np.frombuffer(r["held"], dtype=np.int32) for r in data]
    row = np.repeat(np.arange(len(data)), [len(h) for h in held])
    column = np.concatenate([*held, np.empty(0, dtype=np.int32)]).astype(np.int64)
    fold = np.array([r["fold"] for r in data], dtype=np.int64)
    y = np.array([[-1 if r[c] is None else r[c] for c in codes] for r in data], dtype=float).reshape(len(data), len(codes))

    def fit(i: int, train: np.ndarray, parts: list[int], earlier: np.ndarray) -> Linear:
        n, p = totals[i, parts].sum(axis=0)
        if not train.any() or p in (0, n):
            return Linear(known[:0], np.zeros(len(known)), np.zeros(earlier.shape[1]), -30.0 if p == 0 else 30.0)
        stands = standing_out(*(table[:, i, parts].sum(axis=1).T), n, p, least_deviation)
        on = np.flatnonzero(stands & np.isin(known, np.array(sorted(own[i]), dtype=np.int64)))
        place = np.full(len(known), -1)
        place[on] = np.arange(len(on))
        number = np.cumsum(train) - 1
        use = train[row] & (place[column] >= 0)
        w, e, b = train_linear(number[row[use]], place[column[use]], len(on), earlier[train], y[train, i])
        weights = np.zeros(len(known))
        weights[on] = w
        return Linear(known[on], weights, e, b)

    models, out_of_fold = [], np.zeros((len(data), 0))
    for i in range(len(codes)):
        labelled = y[:, i] >= 0
        final = fit(i, labelled, list(range(FOLDS)), out_of_fold)
        odds = final.odds(row, column, len(data), out_of_fold)
        if i + 1 < len(codes):
            for part in range(FOLDS):
                others = [f for f in range(FOLDS) if f != part]
                model = fit(i, labelled & (fold != part), others, out_of_fold)
                here = fold == part
                odds[here] = model.odds(row, column, len(data), out_of_fold)[here]
        models.append(final)
        out_of_fold = np.column_stack([out_of_fold, np.clip(odds, -30, 30)])
    return Chain(names, known, tuple(models))


def predict_chain(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``p_<category>`` for every row. Null and empty texts have no features."""
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def predict(batches: Batches) -> Iterable[dict]:
        place = {f: i for i, f in enumerate(chain.features.tolist())}
        cache: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for batch in slices(whole):
                held = []
                for content in batch.column("text").to_pylist():
                    if len(cache) > CACHE:
                        cache.clear()
                    found: set[int] = set()
                    for word in set(TOKEN.findall((content or "").lower())):
                        on = cache.get(word)
                        if on is None:
                            on = cache[word] = tuple(place[f] for f in features(word) if f in place)
                        found.update(on)
                    held.append(np.fromiter(found, dtype=np.int64, count=len(found)))
                row = np.repeat(np.arange(len(held)), [len(h) for h in held])
                column = np.concatenate([*held, np.empty(0, dtype=np.int64)])
                p = chain.probabilities(row, column, len(held))
                yield {"doc_id": batch.column("doc_id")} | {f"p_{c}": p[:, i] for i, c in enumerate(chain.categories)}

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    return arrow_map(rows, predict, schema + "".join(f", p_{c} double" for c in chain.categories))
