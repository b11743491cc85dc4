"""Language, personal data, benchmark items, pages, conversations, toxicity and scoring on small inputs."""

import hashlib
import json
import random
import re
from html import unescape as decoded

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, html, language, language_model, pii, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {"en": "the and of to with from that have this will", "fr": "les des une dans pour avec être elle nous"}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, prose(lang, 40, i), lang) for i, lang in enumerate(["en", "fr"] * 20)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!", "fr"), (None, prose("en", 30, 7), None), (0, rows[0][1], "en")]
    return spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumns(
        {"score": F.lit("x"), "lang_pred": F.lit(1)}
    )


def test_language_of_odd_texts(corpus):
    filters = language.fit_language(corpus)
    found = language.predict_language(corpus, filters, keep=("lang",)).collect()
    assert len(found) == corpus.count()
    assert all(r.lang_pred == r.lang for r in found if r.doc_id is not None and r.doc_id < 100)
    assert {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (100, 101, 102)} == {
        i: ("und", 0.0) for i in (100, 101, 102)
    }
    assert all(0 <= r.score <= 1 for r in found)


def test_language_without_training_rows(spark, corpus):
    filters = language.fit_language(corpus.where("false"))
    assert {r.lang_pred for r in language.predict_language(corpus, filters).collect()} == {"und"}
    assert language.predict_language(corpus.where("false"), filters).count() == 0


def test_filters_equal_sets_but_for_false_positives():
    rng = np.random.default_rng(1)
    grams = {lang: set(rng.integers(0, 1 << 60, 300).tolist()) for lang in "ab"}
    filters = language.build_filters([(k, g, 0.1) for k, v in grams.items() for g in v], (0.01,))
    for bit, lang in enumerate("ab"):
        every = np.array(sorted(grams["a"] | grams["b"]))
        has = (filters.lookup(every)[0] >> np.uint64(bit)) & np.uint64(1)
        assert all(h for g, h in zip(every.tolist(), has, strict=True) if g in grams[lang])
    other = rng.integers(0, 1 << 60, 20_000)
    assert np.mean(filters.lookup(other)[0] & np.uint64(1)) < 0.02


def base_by_patterns(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    found += [("ip", *m.span()) for m in ips if all(int(x) <= 255 for x in m[0].split("."))]
    cards = re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
    found += [("card", *m.span()) for m in cards if 13 <= len(digits(m)) <= 19 and pii.passes_luhn(digits(m))]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
    return found + [("phone", *m.span()) for m in phones if 9 <= len(digits(m)) <= 15]


def test_plain_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..--1234567890 +(") for _ in range(rng.randint(0, 40)))
        assert pii.detect(t) == base_by_patterns(t), t


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("or jane.doe at mail dot example dot org", "email", "jane.doe at mail dot example dot org"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("user@exa​mple.com", "email", "user@exa​mple.com"),
        ("call plus four four two zero seven nine four six zero nine", "phone", "plus four four two zero seven nine four six zero nine"),
        ("at one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
        ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
        ("to john @ example . com today", "email", "john @ example . com"),
        ("card 4111\u20131111\u20131111\u20131111", "card", "4111\u20131111\u20131111\u20131111"),
        ("tel +1\u00a0555\u00a0010\u00a09999 x", "phone", "+1\u00a0555\u00a0010\u00a09999"),
        ("ip \u0661\u0669\u0662.\u0661\u0666\u0668.\u0660.\u0661", "ip", "\u0661\u0669\u0662.\u0661\u0666\u0668.\u0660.\u0661"),
    ],
)
def test_disguised_spans_map_back(text, kind, source):
    assert [(k, text[a:b], plain) for k, a, b, plain in pii.find_all(text)] == [(kind, source, False)]


@pytest.mark.parametrize("text", ["he is at home. The dot com era", "one two three go", "john at example.com", "a 12 [at] b", "a - b . c @ d", "il dit\u00a0: 5\u00a0000"])
def test_clean_texts_have_no_spans(text):
    assert pii.find_all(text) == []


def test_pii_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.co x +1 (555) 010-9999", "k"), (1, "a@b.co x +1 (555) 010-9999", "k"), (2, None, "k"), (None, "", "k")],
        "doc_id bigint, text string, spans string",
    )
    found = sorted(pii.find_pii(docs, masked=True).collect(), key=str)
    assert sorted(str(r.masked_text) for r in found) == ["", "<EMAIL> x <PHONE>", "<EMAIL> x <PHONE>", "None"]
    assert sorted(len(r.spans) for r in found) == [0, 0, 2, 2]
    assert pii.find_pii(docs.where("false")).count() == 0


def test_very_long_texts_take_linear_time():
    assert pii.find_all("a" * 300_000 + "1" * 300_000) == []
    assert pii.find_all("1." * 200_000)[:0] == []
    page = "<p>" * 20_000 + "<b>x" * 20_000
    assert html.main_text(page, {"place": [], "constants": []})


def edits_by_table(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance_equals_the_table():
    rng = random.Random(4)
    for _ in range(2_000):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert decontaminate.least_edits(item, text) == edits_by_table(item, text)


def test_leaks_equal_brute_force(spark):
    rng, make = random.Random(5), np.random.default_rng(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, text(25)) for i in range(12)] + [(20, None), (21, "short"), (22, "tiny but counts")]
    docs = []
    for i in range(80):
        part = items[i % 12][1]
        leak = decontaminate.edited(part, int(len(part) * (i % 5) * 0.04), make) if i % 2 else text(20)
        docs.append((i, f"{text(30)} {leak} {text(rng.randint(0, 30))}"))
    docs += [(90, None), (91, ""), (1, docs[1][1]), (92, "so tiny but counts here"), (None, items[0][1])]
    found = decontaminate.find_leaks(
        spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, item_id int"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )
    got = sorted((str(r.doc_id), r.item_id, r.edits) for r in found.collect())
    expected = []
    for i, t in docs:
        for j, item in items:
            if t and item and len(decontaminate.plain(item)) >= 12:
                e = edits_by_table(decontaminate.plain(item), decontaminate.plain(t))
                if e <= int(0.15 * len(decontaminate.plain(item))):
                    expected.append((str(i), j, e))
    assert {g[:2] for g in got} <= {e[:2] for e in expected}
    assert len(got) >= 0.97 * len(expected) and len(expected) > 25
    exact = {e for e in expected if e[2] == 0}
    assert exact <= set(got)


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_leaks(docs, items).count() == 0
    assert decontaminate.find_leaks(docs.where("false"), spark.createDataFrame([(1, "x" * 50)], items.schema)).count() == 0


PAGE = (
    "<html><body><header>Site</header><nav><ul><li>a<li>b</ul></nav><div class='cookie-notice'>We use</div>{}"
    "<div class=comments><p>bad</p></div><footer>f</footer>"
)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE.format("<article><h1>T &amp; x</h1><p>one <b>two</b><br>three<p>four\n  five</article>"), "T & x\none two three\nfour five"),
        (PAGE.format("<div class=content><h2>H</h2><ul><li>a<li>b</ul></div>"), "H\na\nb"),
        ("<article><header><h1>A</h1></header>x<aside>no</aside><form>u</form><p>y <span class=ad>w</span> q</article>", "A\nx\ny\nq"),
        ("<article><script>var t='</p><p>no';</script><!-- no --><p>a &copy; b", "a © b"),
        ("", ""),
        (None, ""),
        ("plain 1 < 2 &am", "plain 1 < 2 &am"),
    ],
)
def test_main_text(page, text):
    assert "\n".join(html.main_text(page, {"place": [], "constants": []})) == text


def test_wrappers_fold_and_align():
    one = html.as_wrapper(html.parse("<div><h2>a</h2><p>x</p><p>y</p><h2>b</h2><p>z</p></div>"))
    assert html.as_wrapper(html.parse("<ul><li>1<li>2<li>3</ul>"))[0][5][0][:3] == ["li", False, True]
    two = html.as_wrapper(html.parse("<div><h2>c</h2><p>x</p></div>"))
    group = html.align(one, two)[0][5]
    assert [n[0] for n in group] == ["(h2 p)"] or any(n[1] for n in group)
    same = html.align(two, two)
    assert same[0][5][0][5][0][5] == "c"
    many = [html.as_wrapper(html.parse("".join(f"<{t}>{t}</{t}>" for t in random.Random(i).choices(["p", "h2", "ul", "pre", "h3"], k=60)))) for i in range(20)]
    whole = many[0]
    for w in many[1:]:
        whole = html.align(whole, w)
    assert len(whole) <= html.LIMIT


def test_constant_notices_outside_articles_go(spark):
    page = "<body><p>Read our terms</p><div><p>{}</p></div></body>"
    rows = [(i, "http://h.org/x", page.format(f"story {i} of many words"), "c") for i in range(5)]
    rows += [(9, None, None, "c"), (10, "http://h.org/x", rows[0][2], "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    for mb in (16, -1):
        found = {r.page_id: r.text for r in html.extract_main_text(pages, broadcast_mb=mb).collect()}
        assert found[3] == "story 3 of many words" and found[9] == "" and found[10] == found[0] and len(found) == 7
    assert html.extract_main_text(pages.where("false")).count() == 0


def test_pages_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", given[r.page_id], re.S)[1]
        parts = [" ".join(decoded(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>|<br>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def test_control_strings_round_trip():
    rng = random.Random(2)
    parts = ["<", "[", "\\", "|", "s>", "/", "INST]", "</s>", "[INST]", "<|turn|>", "<|end|>", "x", "<<SYS>>", "\n"]
    for _ in range(5_000):
        turns = [(rng.random() < 0.5, rng.choice(parts), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(3)]
        formatted, loss = chat.format_turns([*turns, (True, "assistant", turns[0][2])])
        assert chat.read_turns(formatted) == [*turns, (True, "assistant", turns[0][2])]
        assert chat.unescape(formatted[slice(*loss[-1])]) == turns[0][2]
        assert not any(c in chat.escape(turns[0][2]) for c in ("<|", "</s>", "[INST]", "<<SYS>>"))


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (60, 20), (10, 5)])
def test_conversations_by_brute_force(spark, budget, history):
    rng = random.Random(6)
    rows = []
    for conv in [None, *range(8)]:
        for turn in range(rng.randint(1, 40)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", None, "system"])
            rows.append((conv, turn, role, rng.choice([None, "", "a b c " * rng.randint(1, 20), "</s> é"]), 1))
    rows += [(50, 0, "user", "same", 1)] * 3 + [(51, None, "assistant", "x", 1), (51, 0, "user", "y", 1)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cell int")
    windows = chat.format_conversations(frame, budget=budget, history=history)
    found = {r.conv_id: r for r in chat.digest_windows(windows).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        order = sorted(
            [(t is not None, t, ro or "", hashlib.md5((tx or "").encode()).hexdigest(), tx or "") for c, t, ro, tx, _ in rows if c == conv]
        )
        said = "".join(f"{o[2]}\n{o[4]}\n" for o in order)
        loss = "".join(o[4] for o in order if o[2] == "assistant")
        assert r.n_turns == len(order) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        targets = [t for t in chat.read_turns(w.formatted) if t[0]]
        assert w.n_tokens <= budget or len(targets) == 1
        if w.first_token > 0 and any(r[2] == "system" and r[1] == 0 and r[0] == w.conv_id for r in rows):
            assert chat.read_turns(w.formatted)[0][1] == "system"
    assert chat.digest_windows(chat.format_conversations(frame.where("false"))).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        toxic, poor = rng.random() < 0.2, rng.random() < 0.3
        words = [rng.choice("abcdefghijkl") * rng.randint(2, 5) for _ in range(30)] + ["moron"] * toxic + ["%%%"] * poor
        rng.shuffle(words)
        rows.append((i, " ".join(words), "z"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(None, None, "z"), (900, "", "z"), (1, rows[1][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fold string")
    given = spark.createDataFrame(labels + [(None, 1, 1), (2, None, None), (700, 1, 1)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit_chain(docs, given.where("doc_id < 400"), (("low", "quality", 0), ("toxic", "toxic", 1)))
    assert len(chain.models[1].earlier) == 1
    found = toxicity.predict_chain(docs, chain).collect()
    assert len(found) == len(rows)
    held = [(r.p_toxic > 0.5, bool(labels[r.doc_id][2]), r.p_low > 0.5, not labels[r.doc_id][1]) for r in found if r.doc_id and 400 <= r.doc_id < 600]
    assert np.mean([a == b for a, b, _, _ in held]) > 0.97 and np.mean([c == d for _, _, c, d in held]) > 0.97
    nothing = toxicity.fit_chain(docs, given.where("false"), (("toxic", "toxic", 1),))
    assert max(r.p_toxic for r in toxicity.predict_chain(docs, nothing).collect()) < 1e-6


def test_network_slope_equals_differences():
    rng = np.random.default_rng(0)
    start = language_model.Network(128)
    network = language_model.Network(128, start.values.astype(np.float64))
    windows, targets = rng.integers(0, 128, (50, 4)), rng.integers(0, 128, 50)
    slope = network.slope(windows, targets)
    for i in rng.integers(0, len(slope), 20):
        loss = []
        for step in (1e-5, -1e-5):
            values = network.values.copy()
            values[i] += step
            loss.append(-language_model.Network(128, values).log_probabilities(windows, targets).mean())
        assert abs((loss[0] - loss[1]) / 2e-5 - slope[i]) < 1e-6
    every = np.array([network.log_probabilities(np.repeat(windows[:1], 128, 0), np.arange(128))])
    assert abs(np.exp(every).sum() - 1) < 1e-9


def test_pseudo_likelihood_prefers_the_corpus(spark):
    rng = random.Random(9)
    usual = lambda n: " ".join(rng.choice(["red fox runs far", "blue bird sings loud"]) for _ in range(n))
    rows = [(i, usual(30), "k") for i in range(200)] + [(500, "loud far red sings fox blue runs bird " * 10, "k")]
    rows += [(501, None, "k"), (502, "", "k"), (None, rows[0][1], "k"), (0, rows[0][1], "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    found = language_model.score_documents(docs, share=1.0, rounds=3, batch_size=64).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].pll_per_token > by_id[500].pll_per_token + 1
    assert by_id[501].n_tokens == 0 and by_id[502].pll == 0 and by_id[502].pll_per_token is None
    assert abs(by_id[None].pll - by_id[0].pll) < 1e-3
    assert language_model.score_documents(docs.where("false")).count() == 0


def test_hashed_words_score_by_their_own_counts(spark):
    rows = [(i, "often seldom" if i == 0 else "often usual" if i < 51 else "often") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.pll for r in language_model.score_documents(docs, words=1, shared=1).collect()}
    assert abs(found[1] - found[0] - np.log(50)) < 1e-3


def test_every_position_trains_in_one_round():
    texts = ["a", "", None, "a b c", "x " * 1001, "one two"]
    owner = np.repeat(np.arange(len(texts)), [len(language_model.tokens(t)) for t in texts])
    for rounds in (1, 2, 3):
        drawn = [language_model.drawn_in(k, 1 / rounds, texts, owner) for k in range(rounds)]
        assert (np.sum(drawn, axis=0) == 1).all()
        assert all(abs(d.mean() - 1 / rounds) < 0.02 for d in drawn)


@pytest.mark.parametrize("share", [0.08, 0.15])
def test_short_items_are_all_found(spark, share):
    rng, make = random.Random(7), np.random.default_rng(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lengths = [6, 11, 12, 20, 36, 40, 50, 60]
    items = [(n * 100 + i, word(n) if i % 5 == 0 else " ".join(word(5) for _ in range(n))[:n].strip()) for n in lengths for i in range(40)]
    leaks = [(i, decontaminate.plain(decontaminate.edited(t, int(share * len(t)), make))) for i, t in items]
    docs = spark.createDataFrame([(i, f"{word(9)} {t} {word(9)}") for i, t in leaks], "doc_id bigint, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {r.doc_id for r in found if r.doc_id == r.item_id}
    whole = {i for (i, t), (_, e) in zip(items, leaks, strict=True) if decontaminate.least_edits(t, e) <= int(0.15 * len(t))}
    assert len(whole) == len(items) and got == whole


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("call plus 4 four 2 zero 7 nine 4 six 0 nine now", "phone", "plus 4 four 2 zero 7 nine 4 six 0 nine"),
        ("to john\t@\texample.com", "email", "john\t@\texample.com"),
        ("to john@example . com", "email", "john@example . com"),
    ],
)
def test_disguises_need_no_other_hint(text, kind, source):
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_all(text)] == [(kind, source)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class=content><h2>H{0}</h2><ul><li>a{0}<li>b{0}</ul></div>", "H{0}\na{0}\nb{0}"),
        ("<div class=x><h1>T{0}</h1><div class=body><p>long text {0}<p>more {0}</div></div>", "T{0}\nlong text {0}\nmore {0}"),
        ("<div class=x><p>p{0}<blockquote>a much longer one {0}</blockquote></div>", "p{0}\na much longer one {0}"),
        ("<div class=x><section class=a><p>one {0}</section><section class=b><p>other {0}</section></div>", "one {0}\nother {0}"),
    ],
)
def test_everything_of_the_article_stays(page, text):
    wrapper = None
    whole = "<html><body><div class=top>Slogan</div>" + page
    for i in range(5):
        new = html.as_wrapper(html.parse(whole.format(i)))
        wrapper = new if wrapper is None else html.align(wrapper, new)
    rule = html.reading(5, wrapper)
    assert "\n".join(html.main_text(whole.format(3), rule)) == text.format(3)
    other = html.main_text(whole.format(3).replace("</h2>", "</h2><p>Slogan"), rule)
    assert ("Slogan" in other) == ("</h2>" in page)


def test_deep_nesting_and_many_siblings_keep_their_text():
    deep = "<body>" + "<div>" * 5000 + "deep text" + "</div>" * 5000 + "<p>after</p></body>"
    off = "<body><article>" + "<div>" * 300 + "kept<div class='advert'><div>sold</div></div>" + "</div>" * 300 + "</article></body>"
    late = "<body>" + "<div>" * 300 + "<article><p>late</p></article>" + "</div>" * 300 + "<p>aside of it</p></body>"
    empty = {"constants": [], "place": []}
    assert html.main_text(deep, empty) == ["deep text", "after"]
    assert html.main_text(off, empty) == ["kept"]
    assert html.main_text(late, empty) == ["late"]
    broad = ["".join(f"<p class='c{(i * step) % 9973}'>t{i}</p>" for i in range(20_000)) for step in (7, 11)]
    one, two, nested = (html.as_wrapper(html.parse(p)) for p in (*broad, deep))
    assert json.loads(json.dumps(html.align(html.align(one, two), nested)))
    assert len(html.main_text(broad[0], empty)) == 20_000


def test_headings_and_tables_of_the_article_stay():
    page = (
        "<body><article><div class='article-header'><h1>Title</h1></div><h2 id='related-work'>Related work</h2><p>Text.</p>"
        "<table><tr class='header'><td>cell</td></tr></table><div class='site-header'>menu</div></article></body>"
    )
    assert html.main_text(page, {"constants": [], "place": []}) == ["Title", "Related work", "Text.", "cell"]


def test_networks_sent_do_not_grow_with_the_partitions(spark, monkeypatch):
    tasks, plain = [], language_model.arrow_map

    def counted(df, work, schema):
        if schema.startswith("piece"):
            tasks.append(df.rdd.getNumPartitions())
        return plain(df, work, schema)

    monkeypatch.setattr(language_model, "arrow_map", counted)
    docs = spark.range(120).selectExpr("id AS doc_id", "concat('a b ', id % 5, ' c d') AS text").repartition(60)
    rows = language_model.score_documents(docs, words=20, shared=4, least_count=1).collect()
    assert sorted(r.doc_id for r in rows) == list(range(120)) and all(r.n_tokens == 5 and r.pll < 0 for r in rows)
    assert len(tasks) == 2 and max(tasks) <= spark.sparkContext.defaultParallelism


def test_texts_are_split_for_counts_and_numbers_only(spark, monkeypatch):
    read, plain = [], language_model.arrow_map

    def noted(df, work, schema):
        read.append((schema.split()[0], "text" in df.columns))
        return plain(df, work, schema)

    monkeypatch.setattr(language_model, "arrow_map", noted)
    docs = spark.range(20).selectExpr("id AS doc_id", "concat('a b ', id % 5, ' c d') AS text")
    assert language_model.score_documents(docs, words=20, shared=4, rounds=3, least_count=1).count() == 20
    assert sum(text for _, text in read) == 2 and [name for name, _ in read].count("piece") == 3


def test_texts_stay_apart_when_laid_out_from_numbers():
    vocabulary = language_model.Vocabulary({"a": 1, "b": 2}, 4)
    kind = language_model.place_type(vocabulary)
    numbered = [np.array(n, dtype=kind).tobytes() for n in ([], [1, 2], [], [2], [1, 1, 1])]
    places, at_tokens, owner = language_model.lay_out(numbered, kind)
    assert places.tolist() == [0, 0, 0, 0, 1, 2, 0, 0, 0, 0, 2, 0, 0, 1, 1, 1, 0, 0]
    assert at_tokens.tolist() == [4, 5, 10, 13, 14, 15] and owner.tolist() == [1, 1, 3, 4, 4, 4]
    assert language_model.place_type(language_model.Vocabulary({str(i): i + 1 for i in range(1 << 16)}, 4)) == np.uint32


@pytest.mark.parametrize("scale", [1, 60])
def test_levels_equal_plain_softmax(monkeypatch, scale):
    monkeypatch.setattr(language_model, "CELLS", 200)
    rng = np.random.default_rng(1)
    start = language_model.Network(256)
    network = language_model.Network(256, start.values.astype(np.float64) * scale)
    for name in ("group_bias", "word_bias"):
        network.view[name][...] = rng.standard_normal(network.view[name].shape)
    windows, targets = rng.integers(0, 256, (60, 4)), rng.integers(0, 256, 60)
    _, hidden = network.forward(windows)
    large = np.abs(hidden @ network.view["word"][0]).max()
    assert (large > 60) == (scale == 60)
    softmax = lambda x: x - x.max(axis=1, keepdims=True) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))
    groups = softmax(hidden @ network.view["group"] + network.view["group_bias"])
    words = [softmax(hidden @ w + b) for w, b in zip(network.view["word"], network.view["word_bias"], strict=True)]
    wanted = [groups[i, t // network.width] + words[t // network.width][i, t % network.width] for i, t in enumerate(targets)]
    assert np.allclose(network.log_probabilities(windows, targets), wanted)
    slope = network.slope(windows, targets)
    for i in rng.integers(0, len(slope), 20):
        loss = []
        for step in (1e-6, -1e-6):
            values = network.values.copy()
            values[i] += step
            loss.append(-language_model.Network(256, values).log_probabilities(windows, targets).mean())
        assert abs((loss[0] - loss[1]) / 2e-6 - slope[i]) < 1e-5
