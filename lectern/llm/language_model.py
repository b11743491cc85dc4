"""Masked pseudo-likelihood of documents under a window network trained on the whole corpus.

Every token is predicted from the words on both of its sides by a small network in numpy: embeddings of
the window, one hidden layer, and a softmax in two levels (group, then word in the group). A document's
score is the sum of its tokens' conditional log probabilities.

The vocabulary comes from word counts over all documents; other words share hashed places, and the
probability of such a word is that of its place times the word's share of the place's count. The counts
of these words never leave Spark: they reach the scores by a join. Texts are split and looked up once;
training and scoring read the places of their words. Training runs where the documents
are: the positions of all documents are dealt out over the rounds, in each round every task starts from
the same network and trains on the round's positions, and Spark averages the networks by tokens seen.
So what training reads and sends grows with the corpus, while the driver holds one network.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map, slices
from lectern.session import pin

SIDE = 2  # words on each side
GROUP, WIDE_GROUP, WIDE = 64, 256, 1 << 13  # places per group, below and from so many places
EMBEDDING, HIDDEN = 16, 32
PIECE = 1 << 14  # parameters per row when networks travel
FLUSH = 500_000
CELLS = 30_000  # scores worked on at once; larger products are slower a row
LARGE = 40  # bound of scores whose exponentials are taken as they are
PAD = 0


def group_width(size: int) -> int:
    return GROUP if size < WIDE else WIDE_GROUP


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass(frozen=True)
class Vocabulary:
    """Places of frequent words; place 0 is the margin, the last ``shared`` places are hashed."""

    words: dict[str, int]
    shared: int

    @property
    def size(self) -> int:
        least = 1 + len(self.words) + self.shared
        return -(-least // group_width(least)) * group_width(least)

    def lookup(self) -> Places:
        return Places(self)


class Places(dict):
    """Places by word; those of words outside the vocabulary are worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.words)
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > FLUSH:
            self.clear()
            self.update(self.vocabulary.words)
        place = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.vocabulary.shared
        self[word] = place = 1 + len(self.vocabulary.words) + place
        return place


class Hashes(dict):
    """Spark's xxhash64 by word, worked out when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > FLUSH:
            self.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all texts."""

    def count(batches: Batches) -> Iterable[dict]:
        seen: Counter[str] = Counter()
        for whole in batches:
            for text in whole.column("text").to_pylist():
                seen.update(tokens(text))
                if len(seen) > FLUSH:
                    yield {"word": list(seen.keys()), "n": list(seen.values())}
                    seen.clear()
        yield {"word": list(seen.keys()), "n": list(seen.values())}

    return arrow_map(docs, count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """Parameters in one float32 vector, with views by name."""

    def __init__(self, size: int, values: np.ndarray | None = None):
        self.width = width = group_width(size)
        groups = size // width
        shapes = {
            "embedding": (size, EMBEDDING), "hidden": (2 * SIDE * EMBEDDING, HIDDEN), "hidden_bias": (HIDDEN,),
            "group": (HIDDEN, groups), "group_bias": (groups,), "word": (groups, HIDDEN, width), "word_bias": (groups, width),
        }
        total = sum(int(np.prod(s)) for s in shapes.values())
        if values is None:
            values = (np.random.default_rng(1).standard_normal(total) * 0.1).astype(np.float32)
        self.values, self.view, at = values, {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.view[name] = values[at : at + n].reshape(shape)
            at += n

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inputs = self.view["embedding"].take(windows, axis=0).reshape(len(windows), -1)
        return inputs, np.tanh(inputs @ self.view["hidden"] + self.view["hidden_bias"])

    def levels(self, order: np.ndarray, targets: np.ndarray) -> Iterator[tuple[str, tuple, Level, list[tuple[slice, np.ndarray]]]]:
        """The rows' levels, with the rows in ``order``, which is by group: all rows among the groups, then the
        rows of each group among its words. With each level its name, its place there, and runs of rows with
        the columns they chose.
        """
        group, place = targets[order] // self.width, targets[order] % self.width
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        spans = [("group", (...,), group, 0, len(group))]
        spans += [("word", (int(group[a]),), place, a, b) for a, b in pairwise(edges) if a < b]
        factors, large = {}, {}
        for name in ("group", "word"):
            weights, bias = self.view[name], self.view[f"{name}_bias"]
            bound = np.sqrt(HIDDEN * np.einsum("...hw,...hw->...w", weights, weights)) + np.abs(bias)
            large[name] = bound.max(axis=-1) > LARGE
            factors[name] = np.exp(np.where(large[name][..., None], 0, bias))
        for name, at, chosen, start, end in spans:
            level = Level(self.view[name][at], self.view[f"{name}_bias"][at], factors[name][at], large[name][at])
            cuts = [*range(start, end, max(1, CELLS // len(level.bias))), end]
            yield name, at, level, [(slice(a, b), chosen[a:b]) for a, b in pairwise(cuts)]

    def log_probabilities(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        order = _in_order(targets // self.width)
        _, hidden = self.forward(windows[order])
        found = np.zeros(len(targets), dtype=hidden.dtype)
        for _, _, level, runs in self.levels(order, targets):
            for rows, chosen in runs:
                found[rows] += level.log_chances(hidden[rows], chosen)
        out = np.empty_like(found)
        out[order] = found
        return out

    def slopes(self, windows: np.ndarray, targets: np.ndarray) -> Iterator[tuple[str, tuple, np.ndarray]]:
        """Gradient of the mean loss: parameters' name, place there, and theirs. What was named may be changed at once."""
        n, size = len(targets), len(self.view["embedding"])
        order = _in_order(targets // self.width)
        windows = windows[order]
        inputs, hidden = self.forward(windows)
        back = np.zeros_like(hidden)
        for name, at, level, runs in self.levels(order, targets):
            weights = (level.weights * level.factor).T
            if len(runs) > 2:
                weights = np.ascontiguousarray(weights)
            slope, bias_slope = np.zeros_like(level.weights), np.zeros_like(level.bias)
            for rows, chosen in runs:
                own = hidden[rows]
                error, share = level.errors(own, chosen)
                slope += (own * share[:, None]).T @ error
                bias_slope += share @ error
                back[rows] += (error @ weights) * share[:, None]
            over = level.factor / n
            slope *= over
            bias_slope *= over
            yield name, at, slope
            yield f"{name}_bias", at, bias_slope
        back *= 1 - hidden * hidden
        back /= n
        parts, places = self.view["hidden"] @ back.T, windows.T.ravel()
        yield "hidden", (...,), inputs.T @ back
        yield "hidden_bias", (...,), back.sum(axis=0)
        slope = np.empty_like(self.view["embedding"])
        for i in range(EMBEDDING):
            slope[:, i] = np.bincount(places, parts[i::EMBEDDING].ravel(), size)
        yield "embedding", (...,), slope

    def slope(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """``slopes`` as one vector."""
        out = Network(len(self.view["embedding"]), np.zeros_like(self.values))
        for name, at, slope in self.slopes(windows, targets):
            out.view[name][at] = slope
        return out.values

    def learn(self, windows: np.ndarray, targets: np.ndarray, squares: Network, rate: float) -> None:
        """One step down the slope, by each parameter's sum of squared slopes so far."""
        for name, at, step in self.slopes(windows, targets):
            sums = squares.view[name][at]
            sums += step * step
            step *= rate
            step /= np.sqrt(sums)
            self.view[name][at] -= step


@dataclass(frozen=True)
class Level:
    """A softmax over columns. The bias enters as a factor of each column's exponentials.

    Hidden values are within 1, so the weights bound the scores; only where they may be ``large`` are the
    biases added and each row set off from its largest score first.
    """

    weights: np.ndarray
    bias: np.ndarray
    factor: np.ndarray
    large: bool

    def scores(self, hidden: np.ndarray) -> np.ndarray:
        """Scores, without the bias unless they may be large."""
        scores = hidden @ self.weights
        if self.large:
            scores += self.bias
            scores -= scores.max(axis=1, keepdims=True)
        return scores

    def log_chances(self, hidden: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        scores = self.scores(hidden)
        picked = scores[np.arange(len(chosen)), chosen]
        if not self.large:
            picked += self.bias[chosen]
        return picked - np.log(np.exp(scores, out=scores) @ self.factor)

    def errors(self, hidden: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances less one at the chosen columns, but for the factors of the columns and the returned ones of the rows."""
        error = self.scores(hidden)
        sums = np.exp(error, out=error) @ self.factor
        error[np.arange(len(chosen)), chosen] -= sums / self.factor[chosen]
        return error, 1 / sums


def _in_order(places: np.ndarray) -> np.ndarray:
    # Numbers of 16 bits are sorted by digits, in a fraction of the time.
    return np.argsort(places.astype(np.uint16) if places.max(initial=0) < 1 << 16 else places, kind="stable")


OFFSETS = np.array([o for o in range(-SIDE, SIDE + 1) if o], dtype=np.int64)


def number_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row of ``docs``: a ``row`` of its own, ``doc_id``, ``places`` of its tokens as bytes, the ``point`` on the
    circle where its first position lies, ``n_bytes`` of its text, and Spark's hash of each word that shares a place.
    """
    kind, own = place_type(vocabulary), len(vocabulary.words)

    def number(batches: Batches) -> Iterable[dict]:
        lookup, hashes = vocabulary.lookup(), Hashes()
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, chars=1_000_000):
                texts = batch.column("text").to_pylist()
                words, ends = [], []
                for text in texts:
                    words += tokens(text)
                    ends.append(len(words))
                places = np.fromiter(map(lookup.__getitem__, words), dtype=np.int64, count=len(words))
                sharing = np.flatnonzero(places > own)
                hashed = np.fromiter((hashes[words[i]] for i in sharing.tolist()), dtype=np.int64, count=len(sharing))
                raw, size = places.astype(kind).tobytes(), np.dtype(kind).itemsize
                yield {
                    "row": np.arange(row, row + batch.num_rows),
                    "doc_id": batch.column("doc_id"),
                    "places": [raw[size * a : size * b] for a, b in pairwise([0, *ends])],
                    "point": first_points(texts),
                    "n_bytes": pc.binary_length(batch.column("text")).fill_null(0),
                    "hashed": np.split(hashed, np.searchsorted(sharing, ends[:-1])),
                }
                row += batch.num_rows

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {id_type}, places binary, point bigint, n_bytes bigint, hashed array<bigint>"
    return arrow_map(docs, number, schema)


def place_type(vocabulary: Vocabulary) -> type:
    return np.uint16 if vocabulary.size <= 1 << 16 else np.uint32


def lay_out(numbered: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all texts in one line, where the tokens are, and their texts; margins part the texts."""
    joined = np.frombuffer(b"".join(numbered), dtype=kind)
    owner = np.repeat(np.arange(len(numbered)), [len(n) // joined.itemsize for n in numbered])
    at_tokens = np.arange(len(joined)) + SIDE * (owner + 1)
    places = np.full(len(joined) + SIDE * (len(numbered) + 1), PAD, dtype=np.int64)
    places[at_tokens] = joined
    return places, at_tokens, owner


def first_points(texts: list[str | None]) -> np.ndarray:
    return np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)


def drawn_in(number: int, share: float, texts: list[str | None], owner: np.ndarray) -> np.ndarray:
    """Which positions train in a round: a stretch of length ``share`` of a circle, each round the next one.

    A position's point on the circle follows from its text and its place there, whatever task reads it, so
    rounds with ``share`` 1 / rounds are disjoint and together take every position.
    """
    return drawn_from(number, share, first_points(texts), owner)


def drawn_from(number: int, share: float, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``drawn_in`` of texts whose first positions lie at the points ``first``."""
    index = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(first)), side="left")[owner]
    points = (first[owner] + index * 2654435769) % (1 << 32)
    edges = [round(share * k * (1 << 32)) for k in (number, number + 1)]
    return (points - edges[0]) % (1 << 32) < edges[1] - edges[0]


def train(
    docs: DataFrame, vocabulary: Vocabulary, network: Network, rounds: int, share: float, batch_size: int = 16384, rate: float = 0.02
) -> Network:
    size, kind = vocabulary.size, place_type(vocabulary)

    def one_round(frame: DataFrame, start: Network, number: int) -> Network:
        initial = start.values

        def learn(batches: Batches) -> Iterable[dict]:
            local = Network(size, initial.copy())
            squares = Network(size, np.full_like(local.values, 1e-6))
            rng = np.random.default_rng((number, TaskContext.get().partitionId()))
            seen = 0
            for whole in batches:
                for batch in slices(whole, "n_bytes", chars=2_000_000):
                    places, at_tokens, owner = lay_out(batch.column("places").to_pylist(), kind)
                    drawn = at_tokens[drawn_from(number, share, batch.column("point").to_numpy(), owner)]
                    rng.shuffle(drawn)
                    for at in range(0, len(drawn), batch_size):
                        rows = drawn[at : at + batch_size]
                        local.learn(places[rows[:, None] + OFFSETS], places[rows], squares, rate)
                        seen += len(rows)
            if seen:
                pieces = range(0, len(local.values), PIECE)
                yield {
                    "piece": list(pieces),
                    "part": [TaskContext.get().partitionId() // 16] * len(pieces),
                    "weight": [float(seen)] * len(pieces),
                    "mean": [local.values[p : p + PIECE].tobytes() for p in pieces],
                }

        def add(group: pd.DataFrame) -> pd.DataFrame:
            weight = group["weight"].sum()
            mean = sum(np.frombuffer(m, dtype=np.float32) * (w / weight) for m, w in zip(group["mean"], group["weight"], strict=True))
            first = group.iloc[0]
            return pd.DataFrame(
                {"piece": [first["piece"]], "part": [first["part"]], "weight": [weight], "mean": [mean.astype(np.float32).tobytes()]}
            )

        schema = "piece int, part int, weight double, mean binary"
        # Every task sends a network, so there are no more tasks than cores, however many partitions the table has.
        trained = arrow_map(frame.coalesce(frame.sparkSession.sparkContext.defaultParallelism), learn, schema)
        # In two steps, so that no group holds the networks of more than a share of the tasks.
        summed = trained.groupBy("piece", "part").applyInPandas(add, schema).groupBy("piece").applyInPandas(add, schema)
        values = initial.copy()
        for r in summed.collect():
            values[r["piece"] : r["piece"] + PIECE] = np.frombuffer(r["mean"], dtype=np.float32)
        return Network(size, values)

    for number in range(rounds):
        network = one_round(docs, network, number)
    return network


def score_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 32_000,
    shared: int = 256,
    rounds: int = 2,
    share: float | None = None,
    batch_size: int = 16384,
    least_count: int = 5,
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``pll`` (sum of log probabilities) and ``pll_per_token`` for every row.

    Tokens are lower-cased words between white space. Words that occur ``least_count`` times have places of
    their own, but at most the ``words`` most frequent ones (ties in order), since the driver holds the
    network. All others share ``shared`` places; the probability of such a word is its place's, times its
    count over the count of the place's words. Every position trains in one of ``rounds`` rounds; with a
    ``share`` named, each round takes the next such share of the positions. Null and empty texts have 0
    tokens, score 0 and null per token. Repeated rows count as text of their own and score alike.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    texts = rows.select("text")
    counts = pin(count_words(texts))
    frequent = counts.where(F.col("n") >= least_count).orderBy(F.desc("n"), "word").limit(words).collect()
    vocabulary = Vocabulary({r["word"]: i + 1 for i, r in enumerate(frequent)}, shared)
    own = len(vocabulary.words)
    # What the places have in common: the counts of all words less those with places of their own.
    in_place = np.zeros(vocabulary.size)
    for r in counts.groupBy((F.crc32(F.col("word").cast("binary")) % shared).alias("place")).agg(F.sum("n").alias("n")).collect():
        in_place[1 + own + r["place"]] = r["n"]
    for r in frequent:
        in_place[1 + own + zlib.crc32(r["word"].encode("utf-8", "surrogatepass")) % shared] -= r["n"]
    shift = -np.log(np.maximum(in_place, 1))
    network = Network(vocabulary.size)
    numbered = pin(number_words(rows, vocabulary))
    if in_place.any() or frequent:
        positions = numbered.select("places", "point", "n_bytes")
        network = train(positions, vocabulary, network, rounds, 1 / rounds if share is None else share, batch_size)
    values, kind = network.values, place_type(vocabulary)

    def score(batches: Batches) -> Iterable[dict]:
        trained = Network(vocabulary.size, values)
        for whole in batches:
            for batch in slices(whole, "n_bytes", chars=1_000_000):
                places, at_tokens, owner = lay_out(batch.column("places").to_pylist(), kind)
                total = np.zeros(batch.num_rows)
                for start in range(0, len(at_tokens), 65536):
                    rows = at_tokens[start : start + 65536]
                    targets = places[rows]
                    found = trained.log_probabilities(places[rows[:, None] + OFFSETS], targets) + shift[targets]
                    total += np.bincount(owner[start : start + 65536], found, batch.num_rows)
                yield {
                    "row": batch.column("row"),
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": np.bincount(owner, minlength=batch.num_rows),
                    "pll": total,
                }

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {id_type}, n_tokens bigint, pll double"
    scored = pin(arrow_map(numbered.select("row", "doc_id", "places", "n_bytes"), score, schema))
    # Words that occur once add log 1.
    logs = counts.where("n > 1").select(F.xxhash64("word").alias("word"), F.log("n").alias("log_n"))
    named = numbered.select("row", F.explode("hashed").alias("word")).join(logs, "word").groupBy("row").agg(F.sum("log_n").alias("log_n"))
    pll = F.col("pll") + F.coalesce("log_n", F.lit(0.0))
    return (
        scored.join(named, "row", "left")
        .select("doc_id", "n_tokens", pll.alias("pll"), F.when(F.col("n_tokens") > 0, pll / F.col("n_tokens")).alias("pll_per_token"))
    )
