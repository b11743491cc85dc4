"""Benchmark items inside documents, up to edits, by CGK embeddings and bit-sampling LSH.

A random walk embeds a window of text: at each step it writes the current character and moves on by one
or stays, as a random function of step and character says. Two windows at small edit distance fall into
step again after an edit, so they differ in few places of the embedding. A repetition of the LSH is one
walk and a sample of its places; windows whose sampled characters agree meet. Windows start at every
word of a document and of an item, so edits in one part of an item leave other windows alone. Edited
copies of the items themselves, at the highest edit share, tell how many repetitions the target recall
takes, by classes of items of about the same length and number of windows. Classes that do not reach it,
and items shorter than a window, are searched exactly: of an item cut into one piece more than it may
have edits, a piece is left as it was, so documents are searched at every character for the pieces.
Where a window or piece meets, the item-sized stretch around it is compared by exact edit distance. An
edit spoils at most q of the runs of q characters of an item, so stretches that hold too few of its runs
cannot be near enough and are told apart by counting, before any distance.

Texts are compared in lower case with single spaces. Items go through the tasks' memory in chunks of
bounded size, one pass over the documents each; no document moves.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, cached_property, reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map, codepoints, mixed, slices

STEPS, SAMPLED = 28, 16  # steps of the walk, sampled places
PAD = STEPS
GATE_BITS = 20
RUN_OF_STARTS = 1 << 15  # windows walked together, so that what a step touches stays in a core's cache


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@dataclass(frozen=True)
class Walk:
    """``moves[step][symbol]`` is 0 or 1; ``places`` are the sampled steps."""

    moves: np.ndarray
    places: np.ndarray

    @staticmethod
    def random(seed: int, steps: int, sampled: int) -> Walk:
        rng = np.random.default_rng((steps, seed))
        moves = rng.integers(0, 2, size=(steps, 256), dtype=np.int64)
        return Walk(moves, np.sort(rng.choice(steps, size=sampled, replace=False)))

    @staticmethod
    def straight(steps: int) -> Walk:
        """Every character, in order."""
        return Walk(np.ones((steps, 256), dtype=np.int64), np.arange(steps))

    @cached_property
    def packed(self) -> np.ndarray:
        """A symbol and its moves at all steps in one word, so a step looks up one thing."""
        words = np.arange(256, dtype=np.int64) << STEPS
        for step, moves in enumerate(self.moves):
            words |= moves << step
        return words

    def stages(self) -> list[int]:
        """After how many sampled places the windows met so far are told from the rest."""
        n = len(self.places)
        return [*(k for k in (n * 9 // 16, n * 12 // 16) if k), n]

    def keys(self, symbols: np.ndarray, starts: np.ndarray, gates: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Windows (indices into ``starts``) that pass all gates, and the hashes of the sampled characters
        of their embeddings after each stage. Without gates all windows pass."""
        window, at = np.arange(len(starts)), starts.copy()
        key = np.zeros(len(starts), dtype=np.uint64)
        taken, out, sampled, stages = 0, [], set(self.places.tolist()), self.stages()
        words = self.packed[symbols]
        for step in range(int(self.places[-1]) + 1):
            # No place lies outside, but clipping spares a copy of the places.
            here = words.take(at, mode="clip")
            if step in sampled:
                key *= np.uint64(0x9E3779B97F4A7C15)
                key += (here >> STEPS).view(np.uint64)
                taken += 1
            here >>= step
            here &= 1
            at += here
            if step not in sampled:
                continue
            if taken == stages[len(out)]:
                out.append(mixed(key))
                if gates:
                    passed = np.flatnonzero(gates[len(out) - 1][gate_slot(out[-1])])
                    window, at, key = window[passed], at[passed], key[passed]
                    out = [k[passed] for k in out]
        return window, out


def gate_slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with a gap behind each, where texts begin, word starts, and their texts."""
    gap = "\0" * PAD
    points = codepoints(gap.join(["", *texts, ""]))
    symbols = (points ^ (points >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = PAD + np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]).astype(np.int64) if texts else lengths
    gaps = (points == 32) | (points == 0)
    starts = np.flatnonzero(gaps[:-1] & ~gaps[1:]) + 1
    return symbols, begins, starts, np.searchsorted(begins, starts, side="right") - 1


@dataclass(frozen=True)
class Probe:
    """One repetition: item windows by key, with a bitmap of their keys at each stage."""

    walk: Walk
    gates: list[np.ndarray]
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray

    def meet(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``starts``, which ascend, and into the item windows that have equal keys."""
        passed, last = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
        for i in range(0, len(starts), RUN_OF_STARTS):
            part = starts[i : i + RUN_OF_STARTS]
            window, stages = self.walk.keys(symbols[part[0] : part[-1] + PAD], part - part[0], self.gates)
            passed.append(window + i)
            last.append(stages[-1])
        near, keys = np.concatenate(passed), np.concatenate(last)
        low = np.searchsorted(self.keys, keys, side="left")
        n = np.searchsorted(self.keys, keys, side="right") - low
        which = np.repeat(np.arange(len(near)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return near[which], low[which] + within


def build_probe(walk: Walk, items: list[str], offsets: list[list[int]], known: np.ndarray) -> Probe:
    """Windows of the items of numbers ``known`` at their ``offsets``."""
    symbols, begins, _, _ = lay_out([items[i] for i in known])
    counts = [len(offsets[i]) for i in known]
    owner = np.repeat(known, counts)
    at = np.array([o for i in known for o in offsets[i]], dtype=np.int64)
    _, stages = walk.keys(symbols, np.repeat(begins, counts) + at)
    order = np.argsort(stages[-1], kind="stable")
    gates = [np.zeros(1 << GATE_BITS, dtype=bool) for _ in stages]
    for gate, keys in zip(gates, stages, strict=True):
        gate[gate_slot(keys)] = True
    return Probe(walk, gates, stages[-1][order], owner[order], at[order])


def window_offsets(item: str) -> list[int]:
    return [i for i in range(len(item) - STEPS + 1) if i == 0 or item[i - 1] == " "]


def pieces(item: str, edit_share: float) -> tuple[int, list[int]]:
    """Length and offsets of one piece more than the item may have edits."""
    n = int(edit_share * len(item)) + 1
    size = len(item) // n
    return min(size, STEPS), [k * size for k in range(n)]


def exact_probes(items: list[str], known: Iterable[int], edit_share: float) -> list[Probe]:
    by_length: dict[int, list[int]] = {}
    cut = [pieces(t, edit_share) for t in items]
    for i in known:
        by_length.setdefault(cut[i][0], []).append(i)
    offsets = [o for _, o in cut]
    return [build_probe(Walk.straight(n), items, offsets, np.array(which)) for n, which in sorted(by_length.items())]


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    chars = list(text)
    for _ in range(edits):
        at, kind, new = int(rng.integers(len(chars))), int(rng.integers(3)), text[int(rng.integers(len(text)))]
        chars[at : at + (kind < 2)] = [new] * (kind > 0)
        chars = chars or [new]
    return "".join(chars)


def probes_for(items: list[str], edit_share: float, target: float, most: int) -> tuple[list[Probe], list[int]]:
    """Repetitions that find the target share of edited items of every class, and the items of the classes
    that ``most`` repetitions do not suffice for."""
    rng = np.random.default_rng(5)
    offsets = [window_offsets(t) for t in items]
    classes: dict[tuple[int, int], list[int]] = {}
    for i, t in enumerate(items):
        if offsets[i]:
            classes.setdefault((round(3 * np.log2(len(t))), len(offsets[i]).bit_length()), []).append(i)
    names, tried, group = sorted(classes), [], []
    for c, name in enumerate(names):
        drawn = rng.permutation(classes[name])[:200]
        tried += np.repeat(drawn, max(4, -(-400 // len(drawn)))).tolist()
        group += [c] * (len(tried) - len(group))
    copies = [plain(edited(items[i], int(edit_share * len(items[i])), rng)) for i in tried]
    symbols, _, starts, owner = lay_out(copies)
    missed, group, wanted = np.ones(len(tried), dtype=bool), np.array(group, dtype=np.int64), np.array(tried)
    walks, took = [], np.zeros(len(names), dtype=np.int64)
    every = np.array(sorted(i for which in classes.values() for i in which), dtype=np.int64)
    while len(walks) < most and (took == 0).any():
        walks.append(Walk.random(len(walks), STEPS, SAMPLED))
        probe = build_probe(walks[-1], items, offsets, every)
        window, at = probe.meet(symbols, starts)
        missed[owner[window[probe.items[at] == wanted[owner[window]]]]] = False
        share = np.bincount(group, missed) / np.bincount(group)
        took[(took == 0) & (share <= 1 - target)] = len(walks)
    sure = np.array(sorted(i for name, n in zip(names, took, strict=True) if n for i in classes[name]), dtype=np.int64)
    rest = sorted(set(range(len(items))) - set(sure.tolist()))
    return [build_probe(w, items, offsets, sure) for w in walks[: max(took, default=0)]], rest


def least_edits(item: str, stretch: str) -> int:
    """The smallest edit distance between ``item`` and any part of ``stretch`` (bit-parallel)."""
    n = len(item)
    mask, high = (1 << n) - 1, 1 << (n - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(item):
        equal[c] = equal.get(c, 0) | (1 << i)
    plus, minus, score, best = mask, 0, n, n
    for c in stretch:
        eq = equal.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(across | plus) & mask)
        down = plus & across
        score += bool(up & high) - bool(down & high)
        best = min(best, score)
        up <<= 1
        plus = ((down << 1) | (~((across) | up) & mask)) & mask
        minus = up & across & mask
    return best


RUN = 4  # characters a run that are counted for many stretches at once; one more for each of the rest


def run_slots(symbols: np.ndarray, run: int) -> np.ndarray:
    """A 16-bit hash of the run of ``run`` symbols at every place (short of the end)."""
    n = max(0, len(symbols) - run + 1)
    whole = np.zeros(n, dtype=np.uint32)
    for i in range(run):
        whole = (whole + symbols[i : i + n]) * np.uint32(0x9E3779B1)
    return (whole >> np.uint32(16)).astype(np.int64)


def holds_enough(slots: np.ndarray, firsts: np.ndarray, size: int, item: np.ndarray, allowed: int) -> np.ndarray:
    """Which stretches of ``size`` places from ``firsts`` may hold ``item`` (its slots) within ``allowed`` edits.

    What matches has at least ``allowed`` characters less than the item, and all of its runs but ``RUN`` an
    edit are runs of the item. Equal slots of unequal runs only let more stretches pass.
    """
    least = len(item) - (RUN + 1) * allowed
    if least <= 0 or not len(slots):
        return np.ones(len(firsts), dtype=bool)
    marked = np.zeros(1 << 16, dtype=bool)
    marked[item] = True
    enough = []
    step = max(1, (1 << 20) // size)
    for i in range(0, len(firsts), step):
        places = firsts[i : i + step, None] + np.arange(size)
        enough.append(marked[slots.take(places, mode="clip")].sum(axis=1) >= least)
    return np.concatenate(enough) if enough else np.zeros(0, dtype=bool)


def shares_runs(item: np.ndarray, stretch: np.ndarray, allowed: int, marked: np.ndarray) -> bool:
    """Whether enough of the item's longer runs are in the stretch for ``allowed`` edits, both as slots.

    ``marked`` has a place for every slot, all false before and after.
    """
    marked[stretch] = True
    held = np.count_nonzero(marked[item])
    marked[stretch] = False
    return held >= len(item) - (RUN + 1) * allowed


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    edit_share: float = 0.15,
    target: float = 0.99,
    most_repetitions: int = 32,
    chunk_chars: int = 4_000_000,
) -> DataFrame:
    """``doc_id``, ``item_id`` and ``edits``: items found in documents within ``edit_share`` of their length.

    One row per row of ``docs`` and item, with the smallest distance seen. Null and blank texts never
    count on either side; items with equal texts are each found.
    Repeated documents give repeated rows; an item id repeated with other texts counts for each text.
    Items are read to the driver by chunks of about ``chunk_chars`` characters (one item at least).
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    wanted = items.select(items[item_id].alias("item_id"), items[item_text].alias("text")).where("text is not null")
    wanted = wanted.distinct()
    chars = wanted.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    chunks = -(-chars // chunk_chars)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {wanted.schema['item_id'].dataType.simpleString()}, edits int"
    found = []
    for chunk in range(chunks):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect()
        known = [(r.item_id, t) for r in part if (t := plain(r.text))]
        if known:
            texts = [t for _, t in known]
            probes, rest = probes_for(texts, edit_share, target, most_repetitions)
            found.append(_scan(rows, known, probes, exact_probes(texts, rest, edit_share), edit_share, schema))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _scan(rows: DataFrame, group: list[tuple], probes: list[Probe], exact: list[Probe], edit_share: float, schema: str) -> DataFrame:
    allowed = np.array([int(edit_share * len(t)) for _, t in group], dtype=np.int64)
    longest = max(len(t) for _, t in group)
    item_symbols, item_begins, _, _ = lay_out([t for _, t in group])

    def cells(texts: list[str], symbols: np.ndarray, begins: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        """Distinct (item, document, cell) of all meetings, by item; neighbouring alignments share a cell."""
        span = max(map(len, texts)) + 2 * longest + 2
        turns = [(p, starts, owner) for p in probes]
        if exact:
            holders = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            places = begins[holders] + np.arange(len(holders)) - np.searchsorted(holders, holders)
            turns += [(p, places, holders) for p in exact]
        met = [np.empty(0, dtype=np.int64)]
        for probe, at, of in turns:
            window, k = probe.meet(symbols, at)
            item, doc = probe.items[k], of[window]
            cell = (at[window] - begins[doc] - probe.offsets[k]) // (allowed[item] + 1)
            met.append(np.unique((item * len(texts) + doc) * span + cell + longest + 1))
        row, cell = np.divmod(np.unique(np.concatenate(met)), span)
        item, doc = np.divmod(row, len(texts))
        return item, doc, cell - longest - 1

    def scan(batches: Batches) -> Iterable[dict]:
        @cache
        def item_slots(i: int) -> tuple[np.ndarray, np.ndarray]:
            its = item_symbols[item_begins[i] : item_begins[i] + len(group[i][1])]
            return run_slots(its, RUN), run_slots(its, RUN + 1)

        for whole in batches:
            for batch in slices(whole, chars=1_000_000):
                texts = [plain(t) for t in batch.column("text").to_pylist()]
                symbols, begins, starts, owner = lay_out(texts)
                item, doc, cell = cells(texts, symbols, begins, starts, owner)
                slots, longer = run_slots(symbols, RUN), run_slots(symbols, RUN + 1)
                marked = np.zeros(1 << 16, dtype=bool)
                best: dict[tuple[int, int], int] = {}
                edges = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    i = int(item[low])
                    wanted, most = group[i][1], int(allowed[i])
                    its, its_longer = item_slots(i)
                    size = len(wanted) + 3 * most + 1
                    docs, firsts = doc[low:high], cell[low:high] * (most + 1) - most
                    near = holds_enough(slots, begins[docs] + firsts, size, its, most)
                    for d, first in zip(docs[near].tolist(), firsts[near].tolist(), strict=True):
                        if best.get((d, i)) == 0:
                            continue
                        at = int(begins[d])
                        if not shares_runs(its_longer, longer[at + max(0, first) : at + first + size], most, marked):
                            continue
                        stretch = texts[d][max(0, first) : first + size]
                        edits = 0 if wanted in stretch else least_edits(wanted, stretch)
                        if edits <= most:
                            best[d, i] = min(edits, best.get((d, i), edits))
                if best:
                    yield {
                        "doc_id": batch.column("doc_id").take([d for d, _ in best]),
                        "item_id": [group[i][0] for _, i in best],
                        "edits": list(best.values()),
                    }

    return arrow_map(rows, scan, schema)
