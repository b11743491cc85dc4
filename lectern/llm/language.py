"""Language of whole texts by n-gram filters that return a bitmask of languages.

A filter row is a slot of a Bloom filter whose cell is not one bit but a mask: one bit for each
(language, tier). A tier holds the n-grams whose share in the language's training text reaches a
threshold, so frequent n-grams set several bits of their language. Looking an n-gram up is an AND of
its slots' masks and answers for all languages at once. A text adds up the bits of all its n-grams;
what false positives are expected to add is taken off again, and the largest sum decides.

Training counts n-grams over all labelled texts as a Spark aggregation. What reaches the driver is
bounded by the thresholds: a language has at most ``1 / min(tiers)`` n-grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map, codepoints, mixed, narrow, slices, text_runs

UNDETERMINED = "und"
NGRAM = 3
PROBES = 2


ALPHABETIC = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed letter trigrams of the lower-cased texts and the text each is from, run by run.

    Anything but letters counts as a gap; a trigram has a letter in the middle, so a text has as many of
    them as letters. Runs are of about a quarter of a million characters, pieces of one text overlap by
    two, so the arrays stay small whatever the texts are.
    """
    folded = [f" {(t or '').lower()} " for t in texts]
    for rows, pieces, _, _ in text_runs(folded, overlap=NGRAM - 1):
        symbols = codepoints("".join(pieces)).astype(np.int32)
        symbols[~ALPHABETIC[symbols]] = 0
        owner = np.repeat(np.array(rows, dtype=np.int32), [len(p) for p in pieces])
        middle = np.flatnonzero(symbols[1:-1] > 0) + 1
        wide = symbols.astype(np.int64)
        yield (wide[middle - 1] << 42) | (wide[middle] << 21) | wide[middle + 1], owner[middle]


@dataclass(frozen=True)
class Filters:
    """``masks[w][slot]``: 64 of the (language, tier) bits; ``chance``: false-positive rate by bit."""

    languages: tuple[str, ...]
    tiers: int
    masks: np.ndarray
    chance: np.ndarray

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for slot in _slots(grams, self.masks.shape[1]):
            found = self.masks[:, slot] if found is None else found & self.masks[:, slot]
        return found


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    hashed = mixed(grams)
    return [((hashed >> np.uint64(32 * i)) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


def build_filters(rows: list[tuple[str, int, float]], tiers: tuple[float, ...], slots_per_gram: int = 16) -> Filters:
    """Filters from (language, packed n-gram, share of the language's n-grams)."""
    languages = tuple(sorted({lang for lang, _, _ in rows}))
    size = 1 << max(10, int(np.ceil(np.log2(max(1, len(rows)) * slots_per_gram))))
    bits = len(languages) * len(tiers)
    masks = np.zeros((max(1, -(-bits // 64)), size), dtype=np.uint64)
    place = {lang: i for i, lang in enumerate(languages)}
    codes = np.array([place[lang] for lang, _, _ in rows], dtype=np.int64)
    grams = np.array([g for _, g, _ in rows], dtype=np.int64)
    shares = np.array([s for _, _, s in rows])
    chance = np.zeros(bits)
    for code in range(len(languages)):
        for tier, least in enumerate(tiers):
            bit = code * len(tiers) + tier
            for slot in _slots(grams[(codes == code) & (shares >= least)], size):
                np.bitwise_or.at(masks[bit // 64], slot, np.uint64(1) << np.uint64(bit % 64))
            density = np.mean((masks[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1))
            chance[bit] = density**PROBES
    return Filters(languages, len(tiers), masks, chance)


def fit_language(
    docs: DataFrame, text: str = "text", lang: str = "lang", tiers: tuple[float, ...] = (5e-5, 5e-4, 3e-3)
) -> Filters:
    """Filters learned from every row with text and language.

    N-grams are counted inside tasks, then summed by Spark. Rows with null text or language are no
    training rows; without training rows the filters know no language.
    """
    rows = narrow(docs, text=text, lang=lang).where("text is not null and lang is not null")

    def count(batches: Batches) -> Iterable[dict]:
        for whole in batches:
            for batch in slices(whole):
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                names, code = np.unique(langs, return_inverse=True)
                counts: list[Counter] = [Counter() for _ in names]
                for packed, owner in ngrams(batch.column("text").to_pylist()):
                    for one in np.unique(code[owner]) if len(owner) else ():
                        grams, n = np.unique(packed[code[owner] == one], return_counts=True)
                        counts[one].update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
                for one, found in zip(names, counts, strict=True):
                    yield {"lang": [one] * len(found), "gram": list(found), "n": list(found.values())}

    counts = (
        arrow_map(rows, count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    common = counts.join(totals, "lang").where(F.col("n") >= min(tiers) * F.col("total"))
    found = common.select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).collect()
    return build_filters([(r.lang, r.gram, r.share) for r in found], tiers)


def predict_language(
    docs: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``lang_pred`` and ``score`` for every row; map only.

    ``score`` is the share (0 to 1) of the text's n-grams that the chosen language knows, corrected
    for false positives. Null, empty and letterless texts get ``und`` and 0, as does every row if no
    language was learned. Equal sums go to the language first in order. Repeated rows are predicted
    each for itself.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("__text"), *[docs[c] for c in keep if c != text])
    kept = ["doc_id", *[c for c in keep if c != text]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)

    def predict(batches: Batches) -> Iterable[dict]:
        tiers, n_lang = filters.tiers, len(filters.languages)
        for whole in batches:
            for batch in slices(whole, "__text"):
                n = np.zeros(batch.num_rows)
                hits = np.zeros((batch.num_rows, n_lang * tiers))
                for packed, owner in ngrams(batch.column("__text").to_pylist()):
                    n += np.bincount(owner, minlength=batch.num_rows)
                    masks = filters.lookup(packed)
                    for bit in range(n_lang * tiers):
                        has = (masks[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
                        hits[:, bit] += np.bincount(owner[has], minlength=batch.num_rows)
                share = (hits / np.maximum(n, 1)[:, None] - filters.chance) / (1 - filters.chance) if n_lang else hits
                share = np.clip(share, 0, 1).reshape(batch.num_rows, n_lang, tiers)
                total = share.sum(axis=2) if n_lang else np.zeros((batch.num_rows, 1))
                best = np.argmax(np.round(total, 12), axis=1)
                known = (n > 0) & (n_lang > 0)
                score = share[np.arange(batch.num_rows), best, 0] if n_lang else np.zeros(batch.num_rows)
                names = [filters.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                found = {c: batch.column(c) for c in kept} | ({text: batch.column("__text")} if text in keep else {})
                yield found | {"lang_pred": names, "score": np.where(known, score, 0.0)}

    schema += f", `{text}` string" if text in keep else ""
    return arrow_map(rows, predict, f"{schema}, lang_pred string, score double")
