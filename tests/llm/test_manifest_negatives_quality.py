"""Hard negatives, the manifest and the quality rules against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hard_negatives as hn
from lectern.llm import manifest, quality

VECTORS = "vec_id bigint, embedding array<double>, label int, shard int, score int, bucket string"


def expected_negatives(rows, every, positives=5, negatives=3, lower=50, upper=95):
    usable = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.add((i, tuple(math.floor(256 * x) for x in v), str(label)))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        met = [(cut(sum(x * y for x, y in zip(a[1], b[1], strict=True))), b) for b in usable if b[0] != a[0] and len(b[1]) == len(a[1])]
        alike = sorted([(-s, b[0]) for s, b in met if b[2] == a[2]])[:positives]
        for p, i in alike:
            near = sorted((-s, b[0]) for s, b in met if b[2] != a[2] and -lower * p <= 100 * s <= -upper * p)[:negatives]
            out += [(a[0], i, r, n, -p, -s) for r, (s, n) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, every, **how):
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS)
    return sorted(tuple(r) for r in hn.hard_negatives(frame, F.col("id") % every == 0, **how).collect())


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) + 0.7).tolist(), int(rng.integers(4))) for i in range(300)]
    rows += [(1000 + i, rows[10][1], i % 2) for i in range(60)]  # ties among copies
    rows += [rows[20], rows[20], (20, rows[21][1], rows[20][2]), (20, rows[22][1], 9)]  # repeats and a reused id
    rows += [(2000, None, 1), (2010, [], 1), (2011, [], 2), (2020, [1.0, None] + [0.0] * 4, 1), (2030, [float("nan")] * 6, 1)]
    rows += [(2040, [float("inf")] * 6, 1), (2050, [1.0] * 6, None), (None, [1.0] * 6, 1), (2060, [0.0] * 6, 1), (2070, [1.0] * 5, 1)]
    rows += [(2080, [1e7, 1.0, 0.0, 0.0, 0.0, 0.0], 0), (2081, [1e8, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (2090, [1e300, -1.0] + [0.0] * 4, 0)]
    found = mined(spark, rows, 10, shard=64, block=16)
    assert found == expected_negatives(rows, 10)
    assert found == mined(spark, rows, 10)
    # A label that a third of the rows have is cut into several shards and still answers whole.
    hot = [(i, [float(i % 17), 1.0], 1 if i % 3 else i % 5) for i in range(400)]
    assert mined(spark, hot, 20, shard=32, block=8) == expected_negatives(hot, 20)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [], 2) == []
    assert mined(spark, [(2, [1.0], 1)], 2) == []
    assert mined(spark, [(2, [1.0], 1), (4, [1.0], 1), (5, [0.6], 2)], 4) == [(4, 2, 1, 5, 65536, 39168 - 39168 % 256)]


def test_windows_are_cut_exactly():
    for score in (-7, -1, 0, 1, 99, 2**63 - 1, -(2**63) + 1, 12345678901234567):
        assert int(hn.per_cent(np.array([score]), 95)[0]) == 95 * score // 100


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def expected_versions(rows):
    groups = defaultdict(list)
    for doc, source, leaf, changed in rows:
        groups[source].append((doc, leaf, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    trees = {s: tree([m[1] for m in groups[s]]) for s in order}
    upper = tree([trees[s][-1][0] for s in order])
    out = []
    for place, source in enumerate(order):
        for at, (doc, leaf, changed) in enumerate(groups[source]):
            path = siblings(trees[source], at) + siblings(upper, place)
            node = changed or leaf
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((str(doc), leaf, trees[source][-1][0], upper[-1][0], proof, node))
    return sorted(out)


def versions(spark, rows):
    frame = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id bigint, source string, leaf string, changed string, pos int, key string")
    found = manifest.build_manifest(frame).versions()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in found.collect())


@pytest.mark.parametrize("block_levels", [1, 3])
def test_versions_equal_brute_force(spark, monkeypatch, block_levels):
    rng = random.Random(block_levels)
    sizes = {None: 1, "": 2, "a": 16, "b": 17, "é": 256, "z": 257, "hot": 700}
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            doc = rng.choice([None, rng.randrange(10**6)])
            leaf = digest(str(rng.random()))
            rows.append((doc, source, leaf, rng.choice([None, leaf, digest(str(rng.random()))])))
    rows += [rows[-1], rows[-1], (rows[-1][0], *rows[5][1:])]
    if block_levels == 1:
        # Rows of 16 leaves: the same tree, climbed in more rounds.
        monkeypatch.setattr(manifest, "LEVELS", 1)
        monkeypatch.setattr(manifest, "BLOCK", 16)
    assert versions(spark, rows) == expected_versions(rows)


def test_manifest_of_many_groups_and_of_nothing(spark):
    rows = [(i, f"s{i}", digest(str(i)), None) for i in range(300)]
    assert versions(spark, rows) == expected_versions(rows)
    assert versions(spark, []) == []
    assert versions(spark, [(5, None, digest("x"), digest("y"))]) == [
        ("5", digest("x"), digest("x"), digest("x"), digest(""), digest("y"))
    ]


def test_fields_enter_a_leaf_with_their_bytes(spark):
    frame = spark.createDataFrame([(7, None, "é"), (None, "", "ab")], "a bigint, b string, c string")
    found = [r[0] for r in frame.select(manifest.leaf([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert found == [digest("1:7-2:é"), digest("-0:2:ab")]


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_the_definition():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\t\x0b\x0c\r\xa0 é#|") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "a", "a a a a", "x " * 200_000, "y" * 500_000 + " z z z z", "\ud800 a"]
    found = quality.rule_counts(texts)
    rows = list(zip(*[found[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True))
    assert rows == [counted(t) for t in texts]


def spelled(text):
    """Symbols of a text by the docstring: gaps in front and behind, runs of white space as one gap."""
    out, gap = [], True
    for c in text + " ":
        point = ord(c)
        if c in " \t\n\x0b\x0c\r":
            if not gap:
                out.append(0)
            gap = True
            continue
        gap = False
        low = c.lower() if point < 128 else c
        out.append(ord(low) - 96 if "a" <= low <= "z" and point < 128 else 27 if c in "0123456789" else 28 + point % 16 if point < 128 else 44 + point % 20)
    return [0, 0, 0, *out]


class Plain:
    """Modified Kneser-Ney by dictionaries, straight from its definition."""

    def __init__(self, texts):
        grams = Counter()
        for text in texts:
            s = spelled(text)
            grams.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        self.counts = {4: grams}
        for k in (3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.cut = {}
        for k, counts in self.counts.items():
            n = Counter(counts.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
            cut = [i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else -1 for i in (1, 2, 3)]
            self.cut[k] = [c if 0 < c < i else d for i, c, d in zip((1, 2, 3), cut, (0.5, 0.75, 0.75), strict=True)]

    def chance(self, gram):
        k = len(gram)
        if not k:
            return 1 / 64
        counts, cut = self.counts[k], self.cut[k]
        alike = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        below = self.chance(gram[1:])
        if not alike:
            return below
        off = lambda n: cut[min(n, 3) - 1]
        own = counts[gram] - off(counts[gram]) if counts[gram] else 0
        return (own + sum(map(off, alike)) * below) / sum(alike)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    syllables = "the er on and th in be ly of sh".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(55, 90))) + "." for _ in range(40)]
    return texts, word, rng


def test_model_equals_the_definition(spark, prose):
    texts = [*prose[0][:6], "Ähm, 12 % — ça?", "", None, "  lead\t\ttab ", "q" * 30]
    model = quality.fit_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = Plain([t or "" for t in texts])
    seen = list(plain.counts[4])[::7]
    unseen = [(5, 5, 5, 5), (0, 1, 63, 2), (60, 61, 62, 63), (8, 5, 0, 9)]
    packed = np.array([((a * 64 + b) * 64 + c) * 64 + d for a, b, c, d in seen + unseen], dtype=np.int32)
    assert np.allclose(np.exp(model.log_chance(packed)), [plain.chance(g) for g in seen + unseen], rtol=1e-9)
    every = np.arange(64, dtype=np.int32) + 64 * int(packed[0] >> 6)
    assert abs(np.exp(model.log_chance(every)).sum() - 1) < 1e-9


def test_pieces_of_long_texts_give_the_same_grams(monkeypatch):
    text = "one  two\n\n three" * 30 + " " * 40 + "end" + " " * 50
    whole = np.concatenate([g for g, _ in quality.packed_grams([text, "", "a"])])
    runs = quality.text_runs
    monkeypatch.setattr(quality, "text_runs", lambda texts: runs(texts, 7))
    assert np.array_equal(whole, np.concatenate([g for g, _ in quality.packed_grams([text, "", "a"])]))
    s = spelled(text)
    assert [int(g) for g in whole[: len(s) - 3]] == [((s[i - 3] * 64 + s[i - 2]) * 64 + s[i - 1]) * 64 + s[i] for i in range(3, len(s))]


def judged(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, surprise int, low string")
    return quality.judge_quality(frame, quality.fit_model(frame)).collect()


def test_bands_reject_what_is_unlike_its_language(spark, prose):
    texts, word, rng = prose
    noise = " ".join("".join(rng.choice("qxzjkvw#@") for _ in range(6)) for _ in range(70))
    same = " ".join("the" if i % 3 else f"the{'e' * (i % 5)}" for i in range(70))
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(100, noise, "en"), (101, noise.upper(), None), (102, "too short", "en"), (103, None, "en"), (104, "", "xx"), (105, "  \n", "en")]
    rows += [(106, " ".join(["spam ham eggs"] * 40), "en"), (1, texts[3], "en"), (1, texts[3], "en"), (107, " ".join(word() for _ in range(40_000)), "")]
    found = judged(spark, rows)
    assert len(found) == len(rows)
    kept = defaultdict(list)
    for r in found:
        kept[r.doc_id].append(r.kept)
        assert not (r.kept and r.base_failed)
    assert all(all(kept[i]) for i in range(len(texts))) and kept[1] == [True] * 3
    assert not any(k for i in (100, 101, 102, 103, 104, 105, 106) for k in kept[i])
    assert {r.doc_id: r.surprise for r in found}[103] is None
    assert same and word


def test_surprise_is_the_mean_over_the_text(spark, prose):
    texts = prose[0][:5]
    found = {r.doc_id: r.surprise for r in judged(spark, [(i, t, "en") for i, t in enumerate(texts)])}
    plain = Plain(texts)
    for i, text in enumerate(texts):
        s = spelled(text)
        lost = [-math.log(plain.chance(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))]
        assert abs(found[i] - 1000 * sum(lost) / len(lost)) <= 0.5 + 1e-6


def test_quality_of_nothing(spark):
    assert judged(spark, []) == []
    (row,) = judged(spark, [(None, None, None)])
    assert (row.n_words, row.base_failed, row.kept, row.surprise) == (0, True, False, None)
