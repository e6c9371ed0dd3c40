"""Operators 11 to 13 against plain versions, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwire.llm import codes, ranking, tokens
from siftwire.llm.bpe import tokenizer_path


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) that are kept, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = [[min(max(math.floor(4096 * v), -(1 << 27)), 1 << 27) for v in r[1]] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            books[p] = [[sum(c[p][i] for c, o in zip(cut, of, strict=True) if o == j) // of.count(j) for i in range(width)] if j in of else e for j, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per = Counter()
    for r, e in zip(rows, errors, strict=True):
        per[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in f), e, per[r[2]], digest) for r, f, e in zip(rows, found, errors, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies", "line", "large"])
def test_metric_tree_gives_sums_and_codes_of_brute_force(kind):
    rng = np.random.default_rng(3)
    n = 1500
    x = {
        "spread": lambda: rng.integers(-2000, 2000, (n, 8)), "clusters": lambda: rng.integers(-9000, 9000, (20, 8))[rng.integers(0, 20, n)] + rng.integers(-30, 30, (n, 8)),
        "copies": lambda: np.repeat(rng.integers(-5, 5, (3, 8)), n // 3, 0), "line": lambda: np.arange(n)[:, None] // 7 * np.ones(8, int), "large": lambda: rng.integers(-(1 << 27), 1 << 27, (n, 8)),
    }[kind]().astype(np.int64)
    t = codes.tree(x)
    assert sorted(t["order"]) == list(range(len(x))) and (t["x"] == x[t["order"]]).all() and t["count"][0] == len(x)
    # Every ball holds its points, sums are of all below.
    below = {}

    def points(v):
        if v not in below:
            below[v] = list(range(t["from"][v], t["to"][v])) if t["one"][v] < 0 else points(t["one"][v]) + points(t["two"][v])
        return below[v]

    for v in range(len(t["count"])):
        p = t["x"][points(v)].astype(np.int64)
        assert len(p) == t["count"][v] and (p.sum(0) == t["sum"][v]).all()
        assert np.sqrt(((p - t["centre"][v].astype(float)) ** 2).sum(1)).max() <= t["radius"][v] * (1 + 1e-9) + 1e-6
    entries = np.concatenate([x[rng.integers(0, len(x), 12)], x[:1], x[:1], x[5:7] + 1])
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in x.tolist()], dtype=object)
    near = np.array([min(range(16), key=lambda j, r=r: (r[j], j)) for r in d])
    sums, counts, _ = codes.descend(t, entries, False)
    assert (counts == np.bincount(near, minlength=16)).all() and all((sums[j] == x[near == j].sum(0)).all() for j in range(16))
    assert (codes.descend(t, entries, True)[2] == near[t["order"]]).all()


def test_vector_codes_equal_a_plain_version(spark):
    rng = random.Random(4)
    kept = [(i, [rng.uniform(-1, 1) for _ in range(16)], rng.choice([0, 0, 0, 1, None])) for i in range(300)]
    kept += [(900 + i, kept[5][1], 1) for i in range(40)] + [(7, kept[8][1], 2), (None, [0.0] * 16, 0), (950, [1e30, -1e30] * 8, 3)]
    odd = [(1000, None, 0), (1001, [0.1] * 15 + [None], 0), (1002, [float("nan")] * 16, 0), (1003, [float("-inf")] + [0.1] * 15, None), (1004, [], 0), (-5, None, 1), (1005, [0.5] * 8, 1)]
    rows = [(a, v, k, "x", 9) for a, v, k in kept + odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, data int").repartition(5)
    out = codes.compress_vectors(df, block=64)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_codes(kept)
    few = kept[:5]
    got = codes.compress_vectors(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(few)
    assert codes.compress_vectors(spark.createDataFrame(odd[:3], "vec_id long, embedding array<double>, label int")).count() == 0
    assert codes.compress_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def plain_ranks(docs, items, k=10):
    split = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in s or "").split(" ")
    terms = [[w for w in split(t) if w] for _, t in docs]
    n_all, length = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    out = []
    for item, text in items:
        rows = []
        for (doc, _), t in zip(docs, terms, strict=True):
            tf = Counter(t)
            m = 10 + (90 * len(t) * n_all) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in set(split(text)) if tf[w])
            if s > 0:
                rows.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def test_limited_accumulators_keep_all_of_the_best():
    rng = np.random.default_rng(1)
    for trial in range(200):
        size, k = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        lists = []
        for _ in range(int(rng.integers(0, 7))):
            docs = np.flatnonzero(rng.random(size) < rng.random())
            lists.append((docs, rng.integers(0, 1 + 10 ** int(rng.integers(1, 4)), len(docs))))
        lists.sort(key=lambda x: len(x[0]))
        total = np.zeros(size, np.int64)
        for docs, add in lists:
            total[docs] += add
        floor = int(rng.integers(0, 50)) if trial % 2 else 0
        found, score = ranking.limited_accumulators([x for x in lists if len(x[0])], size, k, floor)
        assert len(set(found.tolist())) == len(found) and (total[found] == score).all()
        ranked = sorted(range(size), key=lambda d: (-total[d], d))[:k]
        assert {d for d in ranked if total[d] > max(0, floor - 1)} <= set(found.tolist())


def test_ranks_equal_a_plain_version(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "x9"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(1, 43)]) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "!!"), (503, "w1-W1,w2\x00w3 " * 2000), (3, "w7 w8 É"), (3, "w7 w8 É"), (None, "w7 w8 É"), (None, "w9")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 20)))) for i in range(25)] + [(30, None), (31, "..."), (32, "nowhere"), (5, "w7 W7 w8 é É"), (5, "w7 W7 w8 é É"), (None, "w9 w9")]
    d = spark.createDataFrame([(a, t, "q", 1) for a, t in docs], "doc_id long, text string, query string, score int").repartition(7)
    q = spark.createDataFrame([(a, t, 1) for a, t in items], "item_id long, text string, doc_id int")
    want = plain_ranks(docs, items)
    assert sorted(map(tuple, ranking.rank_documents(d, q).collect()), key=str) == want
    assert sorted(map(tuple, ranking.rank_documents(d, q, most_terms=100).collect()), key=str) == want  # several groups of queries
    small = ranking.best_of_blocks

    def tiny(*args):
        return small(*args, block_postings=60)

    ranking.best_of_blocks = tiny
    try:
        assert sorted(map(tuple, ranking.rank_documents(d, q).collect()), key=str) == want
    finally:
        ranking.best_of_blocks = small
    assert ranking.rank_documents(d.limit(0), q).count() == 0 and ranking.rank_documents(d, q.limit(0)).count() == 0
    assert ranking.rank_documents(d, q, k=1).count() == sum(r[1] == 1 for r in want)


TEXTS = ["", None, "Hello, World!! it's 2024\n\nnaïve café Ⅷ ½ x²", "<|endoftext|> a<|startoftext|>b", "  \t\x0b\x0c\x1c lead nbsp　wide line", "é İstanbul ΣΑΣ ς ǆ ŉ", "don't we'll 'sure 's'", "日本語テキスト 🙂🙂 ok", "a" * 5000, "word " * 3000, "ß ſ ﬁ Å Å", "x.y,z;- -- ...' ‘’"]


def test_word_pieces_are_coded_as_the_library_codes_whole_texts():
    import pyarrow as pa

    coder, rng = tokens.WordIds(tokenizer_path(), keep=50), random.Random(2)
    letters = "abcXYZéİσΣ'’.,-<|> \n\t12²日́"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for part in (texts[:100], texts[100:], texts[:0], texts):
        ids, n = coder.batch(pa.array(part, pa.string()))
        want = [[*coder.t.encode(t, add_special_tokens=False).ids, 1] for t in part]
        assert [x.tolist() for x in np.split(ids, n.cumsum())[:-1]] == want


def test_grammars_give_back_their_ids():
    rng = np.random.default_rng(6)
    for trial in range(30):
        lengths = rng.integers(1, 200, int(rng.integers(1, 30))).astype(np.int64)
        base = int(rng.integers(1, 50000))
        ids = rng.integers(0, min(base, 2 + trial), lengths.sum()) if trial % 3 else np.repeat(7, lengths.sum()) % base
        s = tokens.Shard(tokens.pack(ids.astype(np.uint16), lengths, least=2, gain=10_000))
        assert (s.expand(s.symbols) == ids).all() and (np.diff(s.start) == lengths).all()
        assert trial % 3 or lengths.sum() < 2000 or len(s.symbols) < lengths.sum() / 4
        for k in (0, len(lengths) - 1):
            assert (s.document(k) == ids[s.start[k] : s.start[k + 1]]).all()
        for _ in range(5):
            a = int(rng.integers(0, len(ids)))
            n = int(rng.integers(1, len(ids) - a + 1))
            assert (s.ids(a, n) == ids[a : a + n]).all()
    with pytest.raises(ValueError):
        tokens.Shard(b"none" + bytes(60))


def test_token_files_hold_the_ids_of_all_documents_in_order(spark):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(8)
    docs = [(i * 3 % 401, " ".join(rng.choice(["alpha", "Beta.", "x1", "é"]) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    docs += [(1000 + i, x) for i, x in enumerate(TEXTS)] + [(5, "again"), (5, "again"), (5, None), (None, "no id"), (-2, "first")]
    df = spark.createDataFrame([(a, x, "s", 1) for a, x in docs], "doc_id long, text string, part string, h int").repartition(6)
    shards = tokens.write_shards(df, shard_ids=500)
    assert shards.agg(F.max(F.size("doc_ids"))).first()[0] < 400 and shards.count() > 20
    got = sorted(map(tuple, tokens.read_shards(shards).collect()), key=lambda r: r[1])
    rows = []
    for a, x in docs:
        raw = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        rows.append((a is None, a or 0, zlib.crc32(raw), len(raw) // 4, a))
    assert sorted((g[0] is None, g[0] or 0, g[3], g[2], g[0]) for g in got) == sorted(rows)
    assert [(g[0] is None, g[0] or 0) for g in got] == sorted((r[0], r[1]) for r in rows)
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    assert tokens.read_shards(tokens.write_shards(df.limit(0))).count() == 0
