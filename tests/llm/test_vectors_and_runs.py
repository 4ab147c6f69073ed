"""The vector operators and the periodic runs against plain versions, with the awkward rows; raw elements, samples by row."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airgate.llm import centroids, html_blocks, langid, periodic_runs, top_k

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, score string, query string"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "s", "q") for i, v in rows], VECTORS)


def awkward_vectors(dims, seed=1, n=300):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=dims))]) for i in rng.permutation(n)]
    rows += [(50, rows[3][1]), (rows[5][0], rows[5][1]), (None, rows[6][1]), (-100, rows[7][1]), (1000, [0.0] * dims), (1050, [0.5] * dims), (1050, [0.5] * dims)]
    bad = [(2000, None), (2001, []), (2002, [None] + [0.1] * (dims - 1)), (2003, [float("nan")] * dims), (2004, [float("inf")] + [0.1] * (dims - 1)), (2050, [0.1] * (dims - 1))]
    return rows, bad


def floors(v, scale):
    return [int(np.floor(float(np.float32(x)) * scale)) for x in v]


# ---- centroids


def plain_clusters(rows, k, rounds, scale, salt="3"):
    held = [(i, floors(v, scale)) for i, v in rows]
    first = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    middle = [list(v) for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in held:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            middle[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    said = [(i, *near(v)[::-1]) for i, v in held]
    inertia = {c: sum(d for _, x, d in said if x == c) for c in range(len(middle))}
    told = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), told[c]) for i, c, d in said), key=repr)


@pytest.mark.parametrize("dims,k", [(64, 8), (5, 3)])
def test_clusters_equal_brute_force(spark, dims, k):
    rows, bad = awkward_vectors(dims)
    bad = [b for b in bad if b[1] is None or len(b[1]) != dims or not np.isfinite([np.nan if x is None else x for x in b[1]]).all()]
    got = centroids.cluster_vectors(embeddings(spark, rows + bad), clusters=k, rounds=4, dimensions=dims)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows, k, 4, 1024)


def test_walk_finds_the_smaller_number_on_ties_and_stops_on_proof():
    rng = np.random.default_rng(3)
    for _ in range(60):
        k, dims = int(rng.integers(1, 9)), int(rng.integers(1, 6))
        middle, vectors = rng.integers(-3, 4, (k, dims)), rng.integers(-4, 5, (40, dims))
        number, distance = centroids.Walk(middle).nearest(vectors)
        exact = ((vectors[:, None, :] - middle[None]) ** 2).sum(2)
        assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_clusters_of_few_and_of_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    got = centroids.cluster_vectors(embeddings(spark, rows)).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in got) == [(1, 0), (2, 0)] and len({r["cluster"] for r in got}) == 2
    assert [r["inertia"] for r in centroids.cluster_vectors(embeddings(spark, rows[:1] * 30)).collect()] == [0] * 30
    assert centroids.cluster_vectors(embeddings(spark, [])).count() == 0
    assert centroids.cluster_vectors(embeddings(spark, [(1, None)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="64-bit"):
        centroids.cluster_vectors(embeddings(spark, [(1, [3e5] * 64)])).collect()


# ---- top k


def plain_top(rows, best, scale, every):
    held = [(n, i, floors(v, scale)) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, v in held:
        if i is not None and i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j) for m, j, w in held if m != n))
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(scored[:best], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("dims,at_once", [(64, 8192), (3, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, dims, at_once):
    rows, bad = awkward_vectors(dims)
    bad = [b for b in bad if b[1] is None or not np.isfinite([np.nan if x is None else x for x in b[1]]).all()]
    rows += [(3000, []), (3001, [0.5, 0.25]), (3050, [0.5] * (dims + 3))]
    monkeypatch.setattr(top_k, "BLOCK", 64)
    monkeypatch.setattr(top_k, "SAMPLE", 20)
    data = embeddings(spark, rows + bad)
    held = data.where(centroids.sound(F.col("embedding"))).select("vec_id", centroids.whole(F.col("embedding"), 256).alias("vector"))
    queries = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = top_k.top_k(queries, held, at_once=at_once)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_top(rows, 5, 256, 50)
    if at_once == 8192:
        assert sorted((tuple(r) for r in top_k.nearest_of_set(data).collect()), key=repr) == plain_top(rows, 5, 256, 50)


def test_index_proves_what_it_leaves_out():
    rng = np.random.default_rng(5)
    left_out = 0
    for case in range(40):
        dims, n = int(rng.integers(1, 20)), int(rng.integers(1, 400))
        block = rng.integers(-20, 21, (n, dims)) if case % 2 else np.repeat(rng.integers(-2, 3, (n, 1)), dims, 1)
        query = rng.integers(-20, 21, dims)
        exact = block @ query
        index = top_k.ImpactIndex(block)
        for threshold in (None, int(np.sort(exact)[-min(5, n)]), int(exact.max())):
            rows = set(index.possible(query, threshold, 5).tolist())
            floor = np.sort(exact)[-min(5, n)] if threshold is None else threshold
            assert set(np.flatnonzero(exact >= floor).tolist()) <= rows or (threshold is None and n <= 5 and len(rows) == n)
            left_out += n - len(rows)
    assert left_out > 2000


def test_top_k_of_few_and_of_no_vectors(spark):
    assert top_k.nearest_of_set(embeddings(spark, [])).collect() == []
    assert top_k.nearest_of_set(embeddings(spark, [(50, [1.0])])).collect() == []
    got = top_k.nearest_of_set(embeddings(spark, [(50, [1.0]), (1, [-1.0]), (50, [1.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(50, 1, 50, 65536)] * 2 + [(50, 2, 1, -65536)] * 2


# ---- periodic runs


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(6, 4 * q):
                out.setdefault((start, i - start + q), q)
            i = max(i, start + 1) if i > start else i + 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def repeated_words(rng, n):
    words = []
    while len(words) < n:
        root = list(rng.choice(list("abc"), int(rng.integers(1, 14))))
        if rng.random() < 0.4:  # periods inside a period
            root = root[: int(rng.integers(1, 4))] * int(rng.integers(2, 12)) + ["d"]
        words += root * int(rng.integers(1, 8)) + root[: int(rng.integers(0, len(root) + 1))]
    return words[:n]


def test_runs_equal_brute_force():
    rng = np.random.default_rng(7)
    texts = [[w.encode() for w in repeated_words(rng, int(rng.integers(0, 150)))] for _ in range(300)] + [[b"a"] * n for n in range(30)]
    found = [r for k in range(0, len(texts), 11) for r in periodic_runs._search(texts[k : k + 11])]
    assert found == [plain_runs(t) for t in texts] and sum(map(len, found)) > 1000


def test_successor_equals_brute_force():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic_runs.Successor(values)
        left, least = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        right = np.maximum(left, rng.integers(0, n + 1, 200))
        plain = [min((v for v in values[a:b] if v >= p), default=n) for a, b, p in zip(left, right, least, strict=True)]
        assert tree.of(left, right, least).tolist() == plain


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(((-m, s, q) for s, m, q in runs), default=None)
    first = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words))


def test_digests_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), " ".join(repeated_words(rng, int(rng.integers(0, 80))))) for i in range(400)]
    rows += [(None, "a " * 9), (None, None), (500, None), (501, ""), (502, " \t\n "), (503, "é é é é é é é"), (7, "x\x0bx x x\x0cx x"), (7, "x\x0bx x x\x0cx x"), (504, "1" * 50_000)]
    rows += [(505, "a b " * 5_000), (506, " ".join(f"w{i}" for i in range(30_000))), (507, "a " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 3, 1, "r") for i, t in rows], "doc_id long, text string, collapsed string, n_words int, _g int, runs string")
    got = periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.with_repeated_tails(docs)))
    want = [plain_digest(*r) for r in rows if r[0] not in (505, 506, 507)]
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id not in (505, 506, 507)").collect()), key=repr) == sorted(want, key=repr)
    said = {r["doc_id"]: r for r in got.where("doc_id in (505, 506, 507)").collect()}
    assert (said[505]["n_runs"], said[505]["length"], said[505]["period"]) == (1, 10_000, 2) and said[507]["length"] == 20_000
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert {zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None} == {True, False}


def test_collapsed_text_tells_each_run_once(spark):
    docs = spark.createDataFrame([("k", "so a b a b a b a b it goes go go go go go go on")], "key string, body string")
    got = periodic_runs.periodic_runs(docs, "key", "body").first()
    assert [tuple(r) for r in got["runs"]] == [(1, 8, 2), (11, 6, 1)] and got["collapsed"] == "so a b it goes go on"


def test_words_of_different_texts_make_no_run():
    batch = pa.record_batch({"k": [1, 2, 3], "t": ["a a a", "a a a a a", None]})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.string())])
    (out,) = periodic_runs._annotate(schema, 1)([batch])
    assert out.column("runs").to_pylist() == [[], [], []] and out.column("collapsed").to_pylist() == ["a a a", "a a a a a", ""]


# ---- earlier operators


@pytest.mark.parametrize("name", ["script", "style", "textarea", "template"])
@pytest.mark.parametrize("slash", ["", "/", " /", ' src="/x.js"/'])
def test_raw_elements_end_at_their_end_tag_only(name, slash):
    page = f"<article><p>One two.</p><{name}{slash}>var t = 1; send(t);</{name}><p>Three <a href=/x/>four</a> five.</p></article>"
    found = html_blocks.blocks(page)
    assert " ".join(b[1] for b in found) == "One two. Three four five."
    assert 0 < found[1][2] < 1  # the link ends where its end tag stands
    assert html_blocks.blocks(f"<p>a</p><{name}{slash}>rest") and len(html_blocks.blocks(f"<p>a</p><{name}{slash}>rest")) == 1
    assert [b[1] for b in html_blocks.blocks("<p>a<svg/>b</p>")] == ["ab"]


def test_rows_of_one_id_keep_their_language(spark):
    english = "the house of the river and the people who were there with their children when it was {} late in the evening"
    german = "das Haus an dem Fluss und die Leute die dort mit ihren Kindern waren als es {} spät am Abend war und nicht ging"
    learnt = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    for a, b in ((learnt[0], learnt[1]), (learnt[2], learnt[3]), (learnt[4], learnt[4])):
        rows = [(a, english.format(k), "en") for k in range(900)] + [(b, german.format(k), "de") for k in range(900)] + [(a, english.format("x"), "en")] * 50
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        seen = []
        fit = langid.fit
        langid.fit = lambda sample, *rest: seen.append(sample) or fit(sample, *rest)
        try:
            said = langid.identify_languages(docs)
            total = {r["lang_pred"]: r["count"] for r in said.groupBy("lang_pred").count().collect()}
        finally:
            langid.fit = fit
        assert total == {"en": 950, "de": 900}
        assert all(sum(x == lang for _, x in sample) == min(langid.SAMPLE, 900) or lang == "en" for sample in seen for lang in ("en", "de"))
        assert all(sum(x == "en" for _, x in sample) <= langid.SAMPLE for sample in seen)
