"""Operators on whole tables: shards, mixing, similarity joins, the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwire.llm import jaccard, mixing, shard, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_shards_are_gapless_contiguous_and_balanced(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 50) if i % 3 else "a hot text") for i in range(4000)] + [(9000, None), (9001, ""), (9002, "é" * 300)] + [(9003, "same"), (9003, "same")]
    out = shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(40)) and out["grown_shard"].isna().all()
    by = out.groupby("shard")["size"].sum()
    assert by.max() - by.min() <= 2 * (out["size"].sum() / 40) / 20 + 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all(want[r.doc_id] == (r.size, r.text_crc32) for r in out.itertuples())
    assert shard.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_texts_stay_in_one_shard_unless_they_fill_it(spark):
    rows = [(i, f"t{i // 4}") for i in range(4000)]
    out = shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert out.assign(g=out["doc_id"] // 4).groupby("g")["shard"].nunique().max() == 1


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "a", "b", "c", None, "é"])) for i in range(3000)] + [(5000, None, "z"), (5001, "", "z")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    src = dict((r[0], r[2]) for r in rows)
    out["source"] = out["doc_id"].map(src).fillna("￿")
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all() and set(out["copies"]) <= {0, 1, 2}
    g = out.groupby("source").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), given=("source_size", "first"))
    assert (g["size"] == g["given"]).all() and ((g["taken"] - g["target"]).abs() <= out["size"].max()).all()
    # The level rule: targets are min(2 * size, level * weight).
    g = g.sort_index()
    w = np.array([5, 2, 1] * 3)[: len(g)]
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.minimum(2 * g["size"], mid * w).sum() < 1.5 * g["size"].sum() else (lo, mid)
    assert np.allclose(g["target"], np.minimum(2 * g["size"], lo * w))
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(7)).toPandas()
    assert dict(zip(again["doc_id"], again["taken"], strict=True)) == dict(zip(out["doc_id"], out["taken"], strict=True))
    assert mixing.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (3, 65), (2, 50)])
def test_jaccard_join_equals_brute_force(spark, width, percent):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 12, 14, 25, 60, 150, 400]))]
        for _ in range(rng.randint(1, 7)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, len(t) // 12])):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = t[: max(1, int(len(t) * rng.choice([1, 1, 1, 0.95, 0.85, rng.uniform(0.45, 1)])))]
            texts.append(rng.choice(["{}", "{}", " {}\n"]).format(" ".join(t)))
    passage = " ".join(rng.choice(words) for _ in range(55))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += [None, "", " \n", "One Two", "one two", "one two three"]
    sets = [shingle_set(t, width) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want, n = components(len(texts), links), [0] * len(texts)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, links string")
    out = {r.doc_id: r for r in jaccard.jaccard_join(df, width, percent).collect()}
    for i, t in enumerate(texts):
        assert (out[i].n_shingles, out[i].component_id, out[i].n_links) == (len(sets[i]), want[i], n[i]), t
    if percent == 80:
        plain = {r.doc_id: r.component_id for r in jaccard.jaccard_join(df, width, percent, counted=False).collect()}
        assert plain == {i: want[i] for i in range(len(texts))}
        assert jaccard.jaccard_join(df.where("false"), width, percent).count() == 0


def test_jaccard_join_of_long_texts(spark):
    """Sets of thousands of shingles, whose keys are a share of their parts and whose bitmaps are wide."""
    rng = random.Random(4)
    texts = []
    for size in (1200, 4000, 4100):
        base = [f"l{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, size // 36)):
                t[rng.randrange(size)] = f"l{rng.randrange(3000)}"
            texts.append(" ".join(t))
    sets = [shingle_set(t, 5) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want, n = components(len(texts), links), [0] * len(texts)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert 0 < len(links) < 3 * 14 * 13 // 2
    out = {r.doc_id: r for r in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    assert [(out[i].component_id, out[i].n_links) for i in range(len(texts))] == list(zip(want, n, strict=True))


def test_near_copies_with_repeated_ids_and_clashing_names(spark):
    kind = "doc_id long, text string, __row string, `a.b` string"
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "p", "q"), (5, long, "p", "q"), (5, "another text of its own", "p", "q"), (5, "another text of its own", "p", "q"), (None, long, None, None), (7, None, None, None), (8, "", "", "")]
    docs = spark.createDataFrame(rows, kind)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("text is null or text not like 'w0%' or doc_id is null or doc_id = 1").distinct().collect()))
    once = docs.where("doc_id is null or doc_id <> 5")
    assert corpus_pipeline.drop_near_copies(spark, once, "").count() == once.count() == 4
    mixed = corpus_pipeline.mix(spark, docs.withColumn("source", F.lit("s")), "")
    assert mixed.columns == [*docs.columns, "source"]


def test_jaccard_blocks_and_tiles_of_large_groups(spark):
    """A group of near copies far over a block: every link is counted once."""
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(t))
    sets = [shingle_set(t, 3) for t in texts]
    links = [(i, j) for i in range(400) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    want, n = components(400, links), [0] * 400
    for a, b in links:
        n[a] += 1
        n[b] += 1
    out = {r.doc_id: r for r in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(out[i].component_id, out[i].n_links) for i in range(400)] == list(zip(want, n, strict=True))


def test_tile_keys_are_shared_by_every_linked_pair():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for _ in range(1500):
            n = int(rng.integers(4, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            d = bands.differ(len(a), len(a))
            gone, new = int(rng.integers(0, d + 1)), int(rng.integers(0, d + 1))
            b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard.tile_keys(a, bands), jaccard.tile_keys(b, bands)))


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, vid = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            c = rng.standard_normal(32)
            for _ in range(int(rng.integers(1, 4))):
                rows.append((vid, (c + 0.1 * rng.standard_normal(32)).tolist(), label))
                vid += 1
    hot = rng.standard_normal(32)
    for _ in range(300):
        rows.append((vid, (hot + 0.12 * rng.standard_normal(32)).tolist(), 1))
        vid += 1
    rows += [(vid, rows[0][1], 0), (vid + 1, None, 0), (vid + 2, [0.0] * 32, 0), (vid + 3, [float("nan")] * 32, 0), (vid + 4, [None] + [1.0] * 31, 0), (vid + 5, [], 0), (vid + 6, [1.0, 2.0], 0), (vid + 7, (2 * np.array(rows[1][1])).tolist(), rows[1][2])]
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for a, i in enumerate(ok):
        for j in ok[:a]:
            x, y = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((i, j))
    want, n = components(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert [(out[i].component_id, out[i].n_links, out[i].kept) for i in range(len(rows))] == [(w, k, w == i) for i, (w, k) in enumerate(zip(want, n, strict=True))]
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_near_vectors_of_a_large_label(spark):
    """Pairs at a cosine just over the limit among many others, in windows far smaller than the label."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((300, 48))
    y -= (y * x[:300]).sum(1)[:, None] * x[:300]
    y /= np.linalg.norm(y, axis=1)[:, None]
    cos = rng.uniform(0.9805, 0.982, 300)[:, None]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(np.concatenate([x, cos * x[:300] + np.sqrt(1 - cos**2) * y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    assert vectors.enough_passes(3300, 16, 0.93) > 1 == vectors.enough_passes(16, 16, 0.93)
    found = {r.vec_id: r.component_id for r in vectors.near_vectors(df, window=16).collect()}
    assert sum(found[3000 + i] == i for i in range(300)) >= 297 and all(found[i] == i for i in range(3000))


def test_tables_with_odd_rows_and_clashing_names(spark):
    """Null ids, a very long text, repeated rows, and columns named like the operators' own."""
    clash = "row long, h string, n long, component string, bytes long, shard string, copies string, `a.b` string"
    extra = (1, "x", 2, "y", 3, "z", "c", "d")
    texts = [(1, "one two three four"), (2, "w " * 30_000), (None, "one two three four"), (4, None), (1, "one two three four"), (5, "")]
    docs = spark.createDataFrame([(i, t, "s" if i == 1 else None, *extra) for i, t in texts], f"doc_id long, text string, source string, {clash}")
    assert shard.shard_by_bytes(docs).count() == mixing.mix_sources(docs).count() == jaccard.jaccard_join(docs).count() == len(texts)
    sizes = {(r.doc_id, r.size) for r in shard.shard_by_bytes(docs).collect()}
    assert (2, 60_016) in sizes and (4, 16) in sizes
    out = {r.doc_id: r for r in jaccard.jaccard_join(docs).where("doc_id is not null").collect()}
    assert out[2].n_shingles == 1 and out[1].component_id == 1 and out[4].n_shingles == 0
    v = spark.createDataFrame([(1, [1.0, 2.0], "a", *extra), (1, [1.0, 2.0], "a", *extra), (None, [1.0, 2.0], "a", *extra), (3, [0.5] * 5000, "a", *extra)], f"vec_id long, embedding array<double>, label string, {clash}")
    assert vectors.near_vectors(v).count() == 4


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    bad = [f"bad{i}" for i in range(6)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        t = text(60)
        if i % 6 == 0:
            t[5:5] = rng.sample(bad, 4)
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    near = rows[7][1].split()
    near[30] = "other"
    rows += [(300, " ".join(near), "en", "s1", 0), (301, rows[8][1], "en", "s2", 0), (302, " ".join(text(40)) + " password=abcDEF123456789", "de", "s1", 0), (303, None, None, None, None), (304, "", "en", "s0", 0), (305, " ".join(text(30)), "en", "s0", 0), (305, rows[-1][1], "en", "s0", 0)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    clean = by["toxicity"](spark, docs, str(tmp_path))
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and not any(i in kept for i in range(0, 240, 6)) and {303, 304, 302} <= kept and len(kept) >= 200
    one = by["jaccard_join"](spark, docs, str(tmp_path))
    ids = sorted(r.doc_id for r in one.collect())
    assert one.columns == docs.columns and 7 in ids and 8 in ids and 300 not in ids and 301 not in ids and 303 in ids
    masked = {r.doc_id: r for r in by["secret_scan"](spark, docs, str(tmp_path)).collect()}
    assert masked[302].text.endswith("[SECRET]") and masked[302].n_chars == len(masked[302].text) and masked[303].text is None and masked[3].text == rows[3][1]
    mixed = by["mix_sources"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(sum(len((r.text or "").split()) for r in mixed.collect()) - 1.5 * total) <= 4 * 70
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 200
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like those the stages add, nulls, repeated ids and a very long text, through all five stages."""
    extra = ["row", "times", "__row", "__key", "__copy", "a.b", "toxic", "predicted", "score", "spans", "redacted", "copies", "size", "component_id", "gone", "id", "ids"]
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(40)), "s" if i % 2 else None) for i in range(30)]
    texts += [(40, "w1 w2 " * 20_000, "s"), (41, None, None), (42, "", "s"), (None, "w7 w8 w9 w7 w8 w9", "s"), (3, "another text of its own here", "s"), (3, texts[3][1], "s"), (43, texts[5][1] + " token=abcdEFGH123456", "s")]
    rows = [(i, t, None, s, None if t is None else len(t), *[f"{c}{k}" for c in extra]) for k, (i, t, s) in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC + "".join(f", `{c}` string" for c in extra))
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert {r[5:] for r in got} <= {r[5:] for r in rows} and len(got) >= 25, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_near_vectors_of_dense_labels_are_found(spark):
    """Two labels whose vectors all lie close together (pairwise cosine about 0.96 and 0.90), against brute force."""
    rng = np.random.default_rng(21)

    def around(n, near):
        mean = rng.standard_normal(64)
        mean /= np.linalg.norm(mean)
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = np.sqrt(near) * mean + np.sqrt(1 - near) * x
        x[: n // 20] = x[n // 20 : n // 10] + rng.standard_normal((n // 20, 64)) * 0.012  # some true neighbours
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    parts = [around(5000, 0.96), around(2500, 0.90)]
    rows, want, base = [], {}, 0
    for label, x in enumerate(parts):
        links = x @ x.T >= 0.98
        np.fill_diagonal(links, False)
        want |= {base + i: int(k) for i, k in enumerate(links.sum(1))}
        rows += [(base + i, v.tolist(), label) for i, v in enumerate(x)]
        base += len(x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    total = sum(want.values())
    assert total > 500 and all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * total
