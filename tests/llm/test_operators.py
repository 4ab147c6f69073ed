"""Each corpus operator against a plain version of its own, on small fixtures with the awkward rows."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgate.llm import decontam, fingerprints, html_blocks, langid, mixing, near_dup, pii, token_counts, toxicity, url_filter
from airgate.llm.common import components, ranked, table, word_count
from airgate.operators import graph

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid int, word string, key long"
AWKWARD = [
    (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two three four"), (7, "ONE two Three four"),
    (8, "é É ß \u00a0x\u2003y 😀"), (9, "a" * 30_000), (9, "a" * 30_000), (10, "1" * 20_000), (11, "<p>&amp;@+"), (12, "@@@ + +1 1.2.3.4.5.6.7.8"),
]


def docs_of(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 1, "w", 2) for i, t in rows], SCHEMA)


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_word_count_is_that_of_the_rule(spark):
    rows = [(i, t) for i, t in AWKWARD] + [(20, " a b "), (21, "a\x0bb\x0c c"), (22, "  ")]
    got = docs_of(spark, rows).select("text", word_count("text").alias("n")).collect()
    assert all(r["n"] == len(WORD.findall(r["text"] or "")) for r in got)


def test_ranks_and_components(spark):
    ids = spark.createDataFrame([(i * 7919 % 1000,) for i in range(500)], "k long")
    got = {r["k"]: r["pos"] for r in ranked(ids, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def chain_edges(n, width, seed):
    """A chain of n nodes, each linked to the next `width`, with shuffled ids."""
    ids = [int(i) for i in np.random.default_rng(seed).permutation(n)]
    return [(ids[i], ids[i + k]) for i in range(n) for k in range(1, width + 1) if i + k < n]


@pytest.mark.parametrize("found", [components, graph.components])
def test_long_chains_with_shuffled_ids_are_one_component(spark, found):
    edges = chain_edges(1000, 1, 4) + [(a + 5000, b + 5000) for a, b in chain_edges(500, 3, 5)]
    roots = {r["node"]: r["root"] for r in found(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1000)}, **{i + 5000: 5000 for i in range(500)}}


# ---- near duplicates


def plain_groups(rows, n, least):
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= least * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return [(i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows)]


def near_rows():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = list(rng.choice(vocabulary, 120))
        rows.append((1000 - base * 60, " ".join(words)))
        for k in range(12):
            copy = list(words)
            for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
                copy[at] = f"x{base}-{k}-{at}"
            rows.append((1000 - base * 60 + k + 1, " ".join(copy)))
    rows += [(2000 + k, " ".join(rng.choice(vocabulary, 5))) for k in range(30)]
    return rows + [(i, t) for i, t in AWKWARD if i is not None and i != 9] + [(50, "one two three four"), (51, "One TWO three  four")]


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    rows = near_rows()
    got = near_dup.near_duplicates(docs_of(spark, rows), shingle, 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_groups(rows, shingle, 80))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_with_awkward_rows(spark):
    got = near_dup.near_duplicates(docs_of(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert [r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    # Rows without doc_id are linked like others, and rows that repeat are each of their own text.
    text = "one two three four five six"
    got = near_dup.near_duplicates(docs_of(spark, [(None, text), (4, text), (4, "other words of four"), (9, text), (9, text)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("4", 4, True), ("4", 4, True), ("9", 4, False), ("9", 4, False), ("None", 4, False)]
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_densified_signatures_collide_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    for size, shared in ((12, 8), (300, 240)):
        agree = []
        for _ in range(200):
            h = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64) * np.uint64(2)
            a, b = np.sort(h[:size]), np.sort(np.concatenate([h[:shared], h[size:]]))
            agree.append((near_dup.signature(a) == near_dup.signature(b)).mean())
        assert abs(np.mean(agree) - shared / (2 * size - shared)) < 0.03


# ---- fingerprints


def test_fingerprints(spark):
    rows = [(i, " ".join(f"w{(i * 37 + k * (1 + i % 3)) % 90}" for k in range(60 + i))) for i in range(1, 30)]
    rows += [(40, rows[0][1]), (41, ""), (42, None), (43, "é" * 9 + " x"), (None, "alone here"), (45, "long " * 40_000)]
    rows += [(7, "another text of seven"), (7, rows[6][1]), (7, rows[6][1]), (None, "alone here"), (None, None), (-(2**63), "lowest id")]
    docs = docs_of(spark, rows)
    got = fingerprints.edited_fingerprints(docs).collect()
    hashed = {r["text"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = []
    for k, (i, text) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        want.append((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) in (0, 8 * fingerprints.SAMPLES) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[40]["fingerprint"] != ""
    assert by_id[41]["fingerprint"] == by_id[42]["fingerprint"] == ""
    assert by_id[42]["near_next"] == 1.0
    lone = fingerprints.edited_fingerprints(docs_of(spark, [(5, "a b c d"), (5, "a b c d")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in lone] == [(5, 1.0), (5, 1.0)]
    assert fingerprints.edited_fingerprints(docs_of(spark, [])).count() == 0


def test_components_agree_as_often_as_generalised_jaccard(spark):
    """At the production count, with four standard errors of room for each pair and little for the mean of all."""
    texts = [(1, "a " * 6 + "b " * 3 + "c d e"), (2, "a " * 3 + "b " * 3 + "c x y"), (3, "a " * 6 + "b " * 6 + "c d e"), (4, "q r s")]
    rng = np.random.default_rng(11)
    texts += [(10 + k, " ".join(f"t{int(x)}" for x in rng.zipf(1.5, 200) % 60)) for k in range(12)]
    sigs = {r["doc_id"]: np.array(r["sig_text"]) for r in fingerprints.signatures(docs_of(spark, texts).select("doc_id", "text"), ["doc_id"]).collect()}
    assert {len(s) for s in sigs.values()} == {fingerprints.SAMPLES}
    counts = {i: {w: t.split().count(w) for w in t.split()} for i, t in texts}
    off = []
    for a, b in combinations(counts, 2):
        words = {*counts[a], *counts[b]}
        low = sum(min(counts[a].get(w, 0), counts[b].get(w, 0)) for w in words)
        high = sum(max(counts[a].get(w, 0), counts[b].get(w, 0)) for w in words)
        off.append((sigs[a] == sigs[b]).mean() - low / high)
        assert abs(off[-1]) < 4 * 0.0625
    assert abs(np.mean(off)) < 0.04


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


PII_TEXTS = [
    "", None, "x a@b.c_d@e.f @g.h i@j k@l..m n@o.p.", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.3.4 1.2.3 é9.9.9.9", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000",
    "+1 (555) 123-4567. +1() +12 +++44 20 7946 0958 +1.2.3.4.5.6.7.8.9", "mail 😀 me@x.org or +49 30 1234567 from 10.0.0.1, card 4012888888881881!", "9" * 5000, "." * 3000 + "a" * 3000, "a@" * 500,
    "12.34.56.78@9.9.9.9+123456789 1-2-3 4 5-6 7 8 9 0 1 2 3",
]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    texts = PII_TEXTS + ["".join(rng.choice(list("0123456789.+-@ ()ab_%é"), 300)) for _ in range(400)]
    texts += ["".join(rng.choice(list("0123456789 -."), 200)) for _ in range(200)]
    for t in texts:
        assert pii.listed(pii.base_spans(t or "")) == plain_base(t)


def test_personal_data_is_found_and_masked(spark):
    rows = list(enumerate(PII_TEXTS)) + [(None, "a@b.cd"), (3, "a@b.cd")]
    docs = docs_of(spark, rows)
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault((i, hashlib.sha256(plain_base(t).encode()).hexdigest()), t)
    for r in got:
        t = by_text[r["doc_id"], r["base_sha256"]]
        assert {*filter(None, plain_base(t).split(","))} <= {*r["spans"].split(",")}
        assert r["n_email"] == plain_base(t).count("email")
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    masked = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert masked[6] == "mail 😀 <EMAIL> or <PHONE> from <IP>, card <CARD>!" and masked[1] is None
    assert pii.find_personal_data(docs_of(spark, [])).count() == 0


def found_in(rows, got):
    """doc_id -> the found strings by kind, of spans that the bootstrapping added or not."""
    texts = dict(rows)
    return {r["doc_id"]: [(k, texts[r["doc_id"]][int(s) : int(e)]) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in got}


def test_bootstrapping_discovers_identifiers_in_known_contexts(spark):
    """Planted contexts: every unseen identifier in one is found, however many there are, and nothing else."""
    rows = [(i, f"please call the office at +1 (555) 010-{1000 + i} today, thanks number {i}") for i in range(20)]
    unseen = ["555-0100", "030 555 5136", "(310) 555-4510", "0049/89.555.123"]
    rows += [(100 + i, f"please call the office at {u} today, thanks") for i, u in enumerate(unseen)]
    rows += [(200 + i, f"the total was 12{i}45 units in order A{i}77-XY") for i in range(20)]
    rows += [(300 + i, f"write to person{i}@mail.example.org for help") for i in range(6)]
    rows += [(400 + i, f"write to {u} for help") for i, u in enumerate(["jane.doe@intranet", "o.smith@" + "x" * 90, "é.müller@host"])]
    rows += [(500 + i, f'token = "{hashlib.md5(str(i).encode()).hexdigest()}" here') for i in range(5)]
    rows += [(600, 'token = "AbC-9f3k-22Xy-77Qw-Zz01" here'), (601, f"hash {hashlib.md5(b'z').hexdigest()} elsewhere")]
    # Two hops: these contexts hold no seed, but what the first context discovers.
    rows += [(700 + i, f"please call the office at 555 02{i:02d} today, thanks") for i in range(6)]
    rows += [(720 + i, f"our hotline never sleeps: dial 555 02{i:02d} whenever you like") for i in range(6)]
    rows += [(740, "our hotline never sleeps: dial 555 0999 whenever you like"), (741, "nothing sleeps near 555 0999 then")]
    rows += [(800 + i, "word " * 3 + "x" * 500 + f" at +1 (555) 010-{2000 + i} ,") for i in range(5)] + [(810, "word " * 3 + "x" * 500 + " at 555-7788 ,"), (811, "word " * 3 + "x" * 499 + "y at 555-7799 now")]
    got = pii.find_personal_data(docs_of(spark, rows)).collect()
    found = found_in(rows, got)
    want = {100 + i: [("phone", u)] for i, u in enumerate(unseen)}
    want |= {400 + i: [("email", dict(rows)[400 + i].split()[2])] for i in range(3)}
    want |= {500 + i: [("secret", dict(rows)[500 + i].split('"')[1])] for i in range(5)}
    want |= {600: [("secret", "AbC-9f3k-22Xy-77Qw-Zz01")], 601: [], 740: [("phone", "555 0999")], 741: [], 810: [("phone", "555-7788")], 811: []}
    want |= {k + i: [("phone", f"555 02{i:02d}")] for k in (700, 720) for i in range(6)}
    want |= {200 + i: [] for i in range(20)}
    assert {i: found[i] for i in want} == want
    assert all(r["n_found"] == 0 for r in got if r["doc_id"] < 100 or 800 <= r["doc_id"] < 810)
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs_of(spark, rows)).collect()}
    assert clean[102] == "please call the office at <PHONE> today, thanks" and clean[600] == 'token = "<SECRET>" here'
    assert pii.masked("ab cd ef", [("ip", 3, 5), ("email", 4, 7), ("card", 0, 2)]) == "<CARD> <IP>f"


def test_keys_of_the_given_documents_are_found(spark):
    """The given documents hold keys behind one context; all of them are found through it, and only strings of that shape."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = found_in(texts, pii.find_personal_data(docs).collect())
    want = {i: sorted(re.findall(r'token = "([0-9a-f]{40})"', t or "")) for i, t in texts.items()}
    assert {i: sorted(x for k, x in f if k == "secret") for i, f in found.items()} == want and sum(map(len, want.values())) >= 5


# ---- web pages


def test_blocks_of_a_page():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><nav><a href='x>y'>home</a></nav>"
        "<article><h1>Head &amp; more</h1><p><b>One<br>two<p>three&nbsp; <i>f</i>our &#233;</article></body>"
    )
    assert [(b[1], b[0][-1]) for b in html_blocks.blocks(page)] == [("T", "title"), ("home", "a"), ("Head & more", "h1"), ("One two", "b"), ("three four é", "p")]
    assert html_blocks.blocks(None) == html_blocks.blocks("") == html_blocks.blocks("<p></p><br>") == []
    assert len(html_blocks.blocks("<" * 2000 + "<p>x" * 500)) >= 500
    said = lambda page: [b[1] for b in html_blocks.blocks(page)]
    assert said(f'<p data-x="{"a" * 5000} > b">text') == ["text"]
    assert said("<p title=it's>one</p><p>don't</p>") == ["one", "don't"]
    assert said('<p a="1>one</p><p>two') == ["one", "two"]
    assert said("<p>x < y</p><!-- open <p>z") == ["x < y"] and said("a<b c") == ["a<b c"]
    assert len(html_blocks.blocks("<div>" * 3000 + "</p>" * 30_000 + '<i a="' * 3000 + "x")) <= 1


def test_long_pages_are_labelled_whole():
    network = html_blocks.train([])
    pages = ["<article>" + "".join(f"<p>block {k} of words here.</p>" for k in range(n)) + "</article>" for n in (20_000, 19_000, 30, 1)]
    together = html_blocks.main_text(network, pages)
    assert together == [html_blocks.main_text(network, [p])[0] for p in pages]


def test_main_text_of_given_and_built_pages(spark, sf):
    from random import Random

    pages = table(spark, sf, "pages")
    sample = [r["html"] for r in pages.orderBy("page_id").limit(60).collect()]
    network = html_blocks.train(sample)
    for page, text in zip(sample, html_blocks.main_text(network, sample), strict=True):
        marked = html_blocks.landmark_labels(found := html_blocks.blocks(page))
        assert text == "\n\n".join(t for (_, t, _), m in zip(found, marked, strict=True) if m)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng, good, total = Random(99), 0, 0
    for _ in range(60):
        page, kept = html_blocks.built_page(rng, words)
        got = set(html_blocks.main_text(network, [page])[0].split("\n\n"))
        good, total = good + len(got & kept), total + len(got | kept)
    assert good / total > 0.9
    awkward = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (None, "u", "<article><p>x</article>", 1), (4, "u", "plain &lt;text&gt;", 1)], "page_id long, url string, html string, text int")
    rows = html_blocks.extract_main_text(awkward, network).collect()
    assert len(rows) == 4 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_blocks.extract_main_text(awkward.limit(0)).count() == 0


def test_the_network_s_gradients():
    rng = np.random.default_rng(0)
    net = html_blocks.Network(3, hidden=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = html_blocks.padded([rng.normal(size=(4, 3)), rng.normal(size=(2, 3))])
    y = (rng.random(mask.shape) > 0.5) * mask

    def loss():
        p = net.probabilities(x, mask)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum())

    grads = net.gradients(x, mask, y)
    for k, v in net.p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        v[at] += 1e-3
        up = loss()
        v[at] -= 2e-3
        down = loss()
        v[at] += 1e-3
        assert math.isclose((up - down) / 2e-3, np.asarray(grads[k])[at], rel_tol=0.05, abs_tol=2e-4), k


# ---- decontamination


def plain_leaks(docs, items, span, least=decontam.LEAST_SCORE):
    n = len(items)
    parts = {i: decontam.question_and_answer(t) for i, t in items}
    words = {i: decontam.words_of(q) + (decontam.words_of(a) if a != q else []) for i, (q, a) in parts.items()}
    average = sum(map(len, words.values())) / n
    out = set()
    for d, text in docs:
        all_words = decontam.words_of(text)
        for start in range(0, max(1, len(all_words)), span):
            passage = all_words[start : start + 2 * span]
            for i, w in words.items():
                def weight(t, w=w):
                    idf = math.log(1 + (n - (h := sum(t in x for x in words.values())) + 0.5) / (h + 0.5))
                    c = w.count(t)
                    return idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / average))

                if w and sum(weight(t) for t in set(w) & set(passage)) >= least * sum(weight(t) for t in set(w)) - 1e-9:
                    shares = []
                    for part in parts[i]:
                        p = decontam.words_of(part)
                        k = min(5, len(p)) or 1
                        shares.append(decontam.overlap(decontam.runs(p, k), decontam.runs(passage, k)))
                    if min(shares) >= 0.8:
                        out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{int(x)}" for x in rng.zipf(1.4, 4000) % 600]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(8, 50)))) + ". " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 9)))) + ".") for i in range(90)]
    docs = []
    for d in range(120):
        w = list(rng.choice(vocabulary, int(rng.integers(0, 400))))
        if d % 4 == 0:
            at = int(rng.integers(0, len(w) + 1))
            leak = items[d % 90][1].split()
            if d % 8 == 0:
                leak = [x if rng.random() > 0.03 else "changed" for x in leak]
            w[at:at] = leak
        docs.append((d, " ".join(w)))
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x y z"), (3, items[3][1])], "item_id long, text string")
    got = decontam.find_leaks(docs_of(spark, docs + [(500, None), (501, "")]), bench)
    want = plain_leaks(docs, items, decontam.SHORT_ITEM)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 20
    # Several passes over smaller indexes find the same.
    small = decontam.find_leaks(docs_of(spark, docs), bench, per_index=20)
    assert {(r["doc_id"], r["item_id"]) for r in small.collect()} == want
    assert decontam.find_leaks(docs_of(spark, []), bench).count() == 0
    assert decontam.find_leaks(docs_of(spark, docs), bench.limit(0)).count() == 0
    left = decontam.without_leaks(docs_of(spark, docs + [(None, items[0][1])]), bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_wand_retrieves_all_above_the_threshold():
    rng = np.random.default_rng(6)
    items = []
    for i in range(300):
        w = [f"t{int(x)}" for x in rng.zipf(1.3, 20) % 200]
        items.append((i, " ".join(w), " ".join(w), {x: (w.count(x), 1 + hash(x) % 7) for x in w}, len(w)))
    index = decontam.Index(items, 300, 20.0, 64, least=0.35)
    assert [index.ids[k] for k in range(300)] == [i[0] for i in sorted(items, key=lambda i: (i[4], i[0]))]
    for _ in range(60):
        words = list(rng.choice([f"t{k}" for k in range(200)], 40))
        terms = {t for w in words if (t := index.term.get(w)) is not None}
        score = np.zeros(300)
        for t in terms:
            score[index.items[t]] += index.impacts[t]
        got = dict(index.retrieve(terms))
        assert sorted(got) == [int(i) for i in np.flatnonzero(score >= 0.35 - 1e-9)]
        assert all(abs(score[i] - s) < 1e-9 for i, s in got.items())
        # The blocks that are opened hold all of them.
        assert {i for start, b in index.candidates(words) if start == 0 for i, _ in index.retrieve(terms, b)} == set(got)


# ---- language


def test_languages_are_told_apart(spark, sf):
    docs = table(spark, sf, "documents")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 30 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    model = langid.train(docs)
    rows = langid.identify_languages(docs_of(spark, AWKWARD), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 10)} == {"und"}
    assert all(r["held_out"] == (__import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows if r["doc_id"] is not None)
    signs = langid.identify_languages(docs_of(spark, [(1, "²"), (2, "12 ½"), (3, "① _ 7"), (4, "ª"), (5, "Ⅷ"), (6, "le ² et la")]), model).collect()
    assert {r["doc_id"] for r in signs if r["lang_pred"] != "und"} == {4, 6}
    assert langid.identify_languages(docs_of(spark, [])).count() == 0


def test_languages_equal_the_nearest_centroid(spark, sf):
    """Against dense vectors: every gram counted by itself, every centroid compared."""
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.where("char_length(text) < 3000").limit(40).collect()} | {-1: "a", -2: "Ça va", -3: "zwei Worte"}
    got = {r["doc_id"]: r for r in langid.identify_languages(docs_of(spark, list(texts.items())), model).collect()}
    for i, text in texts.items():
        folded = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        counts = np.zeros(langid.BUCKETS)
        for n in langid.GRAMS:
            for at in range(len(folded) + 3 - n if folded else 0):
                h = 0
                for k, c in enumerate(f" {folded} "[at : at + n], 1):
                    h = (h * 0x100000001B3 + ord(c) + k) % 2**64
                counts[int(langid.mix(np.array([h], np.uint64))[0] >> np.uint64(40)) % langid.BUCKETS] += 1
        vector = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        near = vector @ model.centres / max(1e-12, float(np.linalg.norm(vector)))
        want = model.languages[model.owner[int(near.argmax())]] if folded else "und"
        assert got[i]["lang_pred"] == want and (not folded or abs(got[i]["score"] - min(1, max(0, near.max()))) < 1e-5), text[:50]


# ---- tokens


def plain_pieces(word, pieces):
    out, at = 0, 0
    while at < len(word):
        end = len(word)
        while end > at + 1 and word[at:end] not in pieces:
            end -= 1
        out, at = out + 1, end
    return out


def test_automaton_equals_greedy_longest_match():
    rng = np.random.default_rng(7)
    for letters in ("ab", "abcd"):
        pieces = {"".join(rng.choice(list(letters), int(rng.integers(1, 6)))) for _ in range(25)}
        automaton = token_counts.LongestMatch(sorted(pieces))
        for _ in range(1500):
            word = "".join(rng.choice(list(letters + "z"), int(rng.integers(0, 14))))
            assert automaton.count(word) == plain_pieces(word, pieces), (word, pieces)


def test_token_counts(spark, sf):
    pieces = set(token_counts.read_pieces())
    symbols = token_counts.byte_symbols()
    rows = [(i, t) for i, t in AWKWARD] + [(r["doc_id"] + 100, r["text"]) for r in table(spark, sf, "documents").limit(20).collect()]
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in token_counts.token_counts(docs_of(spark, rows)).collect() if r["doc_id"] not in (9, 10))
    want = sorted((i or -1, sum(plain_pieces("".join(symbols[b] for b in w.encode()) + " ", pieces) for w in (t or "").lower().split())) for i, t in rows if i not in (9, 10))
    assert got == want
    assert token_counts.token_counts(docs_of(spark, [])).count() == 0


# ---- urls


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_urls_are_judged(spark, sf):
    urls = [
        None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.COM/DE/1", "https://x.example.net/en/1?q#f", "https://example.net/en", "http://net/", "http://xnet/", "https://a.org/fr/2",
        "https://a.example.com/de/", "http://a.b://c/d", "http://h?x/en/", "http://h#/fr/", "https://www.cheap-casino.info/en/1", "http://blog.river-school.info/en/2", "https://poker-loans.info/es/5", "É://É.net/é",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert [got[i]["verdict"] for i in (15, 16, 17)] == ["block", "allow", "block"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://h.org/" + "path/" * 20_000), (1, "http://h.org/" + "path/" * 20_000)], "page_id long, url string")
    assert len({r["score"] for r in url_filter.judge_urls(long).collect()}) == 1
    labelled = spark.createDataFrame([], "url string, label int")
    assert {r["score"] for r in url_filter.judge_urls(pages, labelled).collect()} == {0.5}


def test_the_model_judges_hosts_that_it_has_not_seen(spark, sf):
    given = {r["host"] for r in table(spark, sf, "pages").select(F.regexp_replace(url_filter.host_of(F.col("url")), r"^(www|m|blog)\\.", "").alias("host")).distinct().collect()}
    assert not given & {re.sub(r"^(www|m|blog)\.", "", re.search("://([^/]*)", u)[1]) for u, _ in url_filter.labelled_urls()}
    urls = url_filter.labelled_urls()
    words = [{w for w in re.findall("[a-z]+", re.search("://([^/]*)", u)[1]) if len(w) > 3} for u, _ in urls]
    fold, url, said = np.random.default_rng(0).integers(0, 4, len(urls)), F.col("url"), []
    for k in range(4):
        # No word of a host that is judged stands in a host that is learned from.
        unseen = set().union(*(w for w, f in zip(words, fold, strict=True) if f == k))
        learn = [x for x, w, f in zip(urls, words, fold, strict=True) if f != k and not w & unseen]
        weights, bias = url_filter.train(spark.createDataFrame(learn, "url string, label int"))
        judged = spark.createDataFrame([x for x, f in zip(urls, fold, strict=True) if f == k], "url string, label int")
        said += judged.select("label", url_filter.probability(url_filter.buckets(url_filter.host_of(url), url_filter.path_of(url)), weights, bias).alias("p")).collect()
    right = {y: np.mean([(r["p"] >= 0.5) == (y == 1) for r in said if r["label"] == y]) for y in (0, 1)}
    assert len(said) == len(urls) and right[0] > 0.9 and right[1] > 0.75


def test_the_model_s_probability_is_that_of_its_grams(spark):
    weights, bias = url_filter.train(url_filter.default_labels(spark))
    pages = [(i, u) for i, u in enumerate(["http://A-b.example.org/X1/y?q", "http://h", "x", None, "http://h.org/é/22"])]
    got = {r["page_id"]: r["score"] for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    for i, u in pages:
        host, path, _, _ = plain_rule(u)
        whole = f"^{host} {path}$".lower()
        shape = "*" + re.sub("[0-9]+", "0", re.sub("[a-z]+", "a", whole))
        grams = [list(x[k : k + n]) for x in (whole, shape) for n in url_filter.GRAMS for k in range(len(x) - n + 1)]
        hashed = spark.createDataFrame([(g,) for g in grams], "g array<string>")
        found = []
        for n in url_filter.GRAMS:
            some = hashed.where(F.size("g") == n)
            found += [r[0] for r in some.select(F.pmod(F.xxhash64(*[F.col("g")[k] for k in range(n)]), F.lit(url_filter.BUCKETS))).collect()]
        z = bias + sum(weights[b] for b in found) / math.sqrt(max(1, len(found)))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    learnt = spark.createDataFrame(url_filter.labelled_urls() * 3 + [(None, 1), ("http://x.org/", None)], "url string, label int")
    again, off = url_filter.train(learnt)
    assert np.allclose(again, weights) and abs(off - bias) < 1e-9


# ---- toxicity


def plain_score(model, rows):
    """The score from its definition: every window of every width, rectified maxima, the threshold of the guessed language."""
    e = model.table[rows].sum(axis=1) if len(rows) else np.zeros((0, toxicity.DIMS))
    e = np.concatenate([e, np.zeros((max(0, 3 - len(e)), toxicity.DIMS))])
    pooled = np.concatenate([np.max([sum(e[i + k] @ f[k] for k in range(w)) for i in range(len(e) - w + 1)], axis=0) for w, f in zip(toxicity.WIDTHS, model.filters, strict=True)]) + model.bias
    p = 1 / (1 + np.exp(-(np.maximum(pooled, 0) @ model.out + model.base)))
    t = model.thresholds[int(model.languages[rows[:, 0]].sum(axis=0).argmax()) if len(rows) else 0]
    return 0.5 * p / t if p < t else 0.5 + 0.5 * (p - t) / (1 - t)


def test_toxic_documents_are_told_apart(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    sample = toxicity.labelled_sample(docs, labels)
    model = toxicity.train(sample)
    scored = toxicity.score_toxicity(docs, model=model).where("held_out").join(labels, "doc_id").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in scored)
    assert len(scored) > 40 and wrong <= 0.12 * len(scored)
    assert not {r[0] for r in sample} & {r["doc_id"] for r in scored}
    rows = toxicity.score_toxicity(docs_of(spark, AWKWARD), model=model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    words = toxicity.Words()
    for r in toxicity.score_toxicity(docs.limit(30), model=model).join(docs, "doc_id").collect():
        assert abs(r["score"] - plain_score(model, words.of(r["text"]))) < 1e-4
    repeated = docs.union(docs).union(docs)
    assert sorted(toxicity.labelled_sample(repeated, labels)) == sorted(sample)
    assert toxicity.score_toxicity(docs_of(spark, []), labels).count() == 0


def test_pooling_takes_each_filter_s_maximum():
    model, rng = toxicity.Classifier(), np.random.default_rng(1)
    e = rng.normal(size=(9, toxicity.DIMS)).astype(np.float32)
    pooled, _ = model._pool(e)
    want = [max(sum(e[i + k] @ f[k][:, c] for k in range(w)) for i in range(10 - w)) for w, f in zip(toxicity.WIDTHS, model.filters, strict=True) for c in range(toxicity.FILTERS)]
    assert np.allclose(pooled, want, atol=1e-4)


# ---- mixing


def plain_targets(sizes, weights, budget, most):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = [s for s in names if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if level * weight[s] >= most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= more


def test_mixing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "B", "é", None, "hot"][min(5, int(rng.integers(0, 9)))]) for i in range(700)]
    rows += [(None, "x y", "a"), (5, "x y", "a"), (5, "x y", "a"), (701, None, "empty")]
    docs = spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], "doc_id long, text string, source string, weight int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes, (3, 1, 2), 1.5 * sum(sizes.values()), 2.0)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target, abs_tol=1e-6) and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= max([r["size"] for r in mine])
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["repeats"] <= 2 for r in got)
    copies = mixing.mixed(docs.withColumnRenamed("weight", "Copy"))
    assert copies.columns == ["doc_id", "text", "source", "Copy", "copy_", "target"]
    count = lambda rows: sorted((str(k), v) for k, v in Counter(rows).items())
    assert count((r["doc_id"], r["text"], r["source"]) for r in copies.collect()) == count((r["doc_id"], t, r["source"]) for r in got for t in [dict(((i, s), x) for i, x, s in rows)[r["doc_id"], r["source"]]] for _ in range(r["repeats"]))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# ---- pipeline


def pipeline_docs(spark, sf):
    """Given documents with rows that repeat, lack an id, a text or words, and columns whose names clash."""
    held = table(spark, sf, "documents").where("char_length(text) < 4000").select("doc_id", "text", "lang", "source", "n_chars").limit(120).collect()
    rows = [(*r, 1, "x", 2, 3.0) for r in held]
    rows += [(None, rows[0][1], *rows[0][2:]), rows[1], rows[1], (rows[2][0], rows[3][1], *rows[2][2:]), (None, None, None, None, None, None, None, None, None), (777, "", "en", None, 0, 1, "y", 2, 3.0), (778, None, "en", "a", None, 1, "y", 2, 3.0)]
    rows += [(None, "call +1 (555) 010-2000 or me@x.org", "en", "a", 34, 1, "y", 2, 3.0), (None, "call +1 (555) 010-2000 or me@x.org", "en", "a", 34, 1, "y", 2, 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, text_hash string, copy int, target double")


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    docs = pipeline_docs(spark, sf)
    rows = docs.collect()
    count = lambda rows: Counter(map(tuple, rows))

    model = toxicity.train(toxicity.labelled_sample(docs, table(spark, sf, "labels")))
    words = toxicity.Words()
    out = corpus_pipeline.toxicity(spark, docs, sf)
    assert out.columns == docs.columns and count(out.collect()) == count(r for r in rows if plain_score(model, words.of(r["text"])) < 0.5)

    # The plain groups of texts, and of each group the row that comes first.
    hashed = [r["h"] for r in docs.select(F.xxhash64("text").alias("h")).collect()]
    root = [g for _, _, g in plain_groups([(k, r["text"]) for k, r in enumerate(rows)], 5, 80)]
    first = {}
    for k, r in enumerate(rows):
        place = (r["doc_id"] is None, r["doc_id"] or 0, hashed[k])
        if plain_words(r["text"]) and place < first.get(root[k], (place[:2] + (2**63,), None))[0]:
            first[root[k]] = (place, r)
    out = corpus_pipeline.near_dedup(spark, docs, sf)
    assert out.columns == docs.columns and count(out.collect()) == count([r for _, r in first.values()] + [r for r in rows if not plain_words(r["text"])])

    items = table(spark, sf, "benchmark").limit(60)
    leaks = plain_leaks([(k, r["text"]) for k, r in enumerate(rows)], [(r["item_id"], r["text"]) for r in items.collect()], decontam.SHORT_ITEM)
    for per_index in (20_000, 20):
        out = decontam.without_leaks(docs, items, per_index=per_index)
        assert out.columns == docs.columns and count(out.collect()) == count(r for k, r in enumerate(rows) if k not in {d for d, _ in leaks})

    spans = {(r["doc_id"], r["base_sha256"]): r["spans"] for r in pii.find_personal_data(docs).collect()}
    want = []
    for r in rows:
        said = spans[r["doc_id"], hashlib.sha256(plain_base(r["text"]).encode()).hexdigest()]
        text, taken = r["text"], [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in said.split(",") if x)]
        if text is not None:
            end, new = 0, ""
            for kind, a, b in taken:
                new += (text[end:a] + f"<{kind.upper()}>") if a >= end else ""
                end = max(end, b)
            text = new + text[end:]
        want.append((r[0], text, r[2], r[3], r[4] if text is None else len(text), *r[5:]))
    out = corpus_pipeline.pii(spark, docs, sf)
    assert out.columns == docs.columns and count(out.collect()) == count(want)

    out = corpus_pipeline.mixing(spark, docs, sf)
    assert out.columns == [*docs.columns, "copy_", "target_"]
    taken = mixing.mix_sources(docs).collect()
    assert out.count() == sum(r["repeats"] for r in taken)
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len(plain_words(r["text"]))
    for s in {r["source"] for r in taken}:
        mine = [r for r in taken if r["source"] == s]
        assert got[s] == sum(r["taken"] for r in mine) and abs(got[s] - mine[0]["target"]) <= max(r["size"] for r in mine)

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name


def test_pipeline_runs_over_whole_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "copy", "target"] and out.count() > 0
    assert out.groupBy("doc_id", "copy").count().where(F.col("count") > 1).count() == 0
