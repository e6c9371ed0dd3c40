"""Operators on single texts: secrets, scores, languages, toxicity, quality, encoding."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwire.llm import bpe, language, lm, quality, secrets, toxicity
from siftwire.llm.registry import oracle_sql, queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, " \t\n", None, "s", 3, "x"), (4, "same words here", "en", "s", 15, "x"), (4, "same words here", "en", "s", 15, "x"), (5, "long " * 60_000, "en", None, 300_000, "x"), (None, "no id at all", "de", "s", 12, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, blanks, repeats, a very long text, and a column whose name an operator gives out too."""
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def brute_base(text):
    text, found = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] * (len(m[2]) >= 12)
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 18), (2, r"[0-9a-f]+", 16)):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    found.sort()
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found]


def test_secrets_match_brute_force_and_the_model_adds_spans(spark):
    rng = random.Random(3)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rand = lambda n, c=chars: "".join(rng.choice(c) for _ in range(n))
    texts = [f"plain words of ordinary text, number {i} " * 3 + rng.choice(["", f"password={rand(14)}", f"Api_Key: '{rand(20)}'", f"é AKIA{rand(16, 'ABCDEFGH0123456789')}", f"token = {rand(5)}", rand(40, "0123456789abcdef"), "ſecret=abcdefghijklmnop", "passwd:" + "x" * 11]) for i in range(300)]
    texts.append("the value Zk93LmQpT7vXw2Rb81NsYq45 stands alone")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in secrets.scan_secrets(docs, secrets.train(docs), redact="[X]").collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, out[i].spans.split(",")))
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
    assert out[len(texts) - 1].n_markov == 1 and "[X]" in out[len(texts) - 1].redacted
    assert not any(r.n_markov for i, r in out.items() if "password" not in texts[i] and not brute_base(texts[i]) and i < 300)


def test_secrets_odd_rows(odd, none):
    rows = secrets.scan_secrets(odd, None).collect()
    assert len(rows) == len(ODD) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)
    assert secrets.train(none) is None and secrets.scan_secrets(none, None).count() == 0


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_padding()
    tok.no_truncation()
    coder, rng = bpe.Coder(bpe.load(bpe.tokenizer_path())), random.Random(1)
    pool = "aaabbeeéÉΣσςİIıſKǺ̧ \t\n 　'strevmlld0１²½Ⅷ漢字🎉!?<|>_endoftextstartoftextͅǅ\x00\x85 "
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>a", "don't WE'LL 'S"]) for _ in range(1500)] + ["a" * n for n in (1, 2, 3, 7, 400)] + ["", " "]
    for t, entries in zip(texts, coder.batch(texts), strict=True):
        ids = [i for e in entries for i in e[3]]
        assert ids == tok.encode(t, add_special_tokens=False).ids, repr(t)
        assert " ".join(e[2] for e in entries) == tok.decode(ids, skip_special_tokens=False)
    full = bpe.encode_texts(odd).collect()
    assert [r.n_tokens for r in full if r.doc_id in (1, 2, 3)] == [0, 0, 0] and len(full) == len(ODD)
    assert bpe.encode_texts(none).count() == 0


def test_language_held_out_and_odd(spark, odd, none):
    rng = random.Random(2)
    syll = {"en": "the ing tion ed er an", "de": "der sch ung ein ich keit", "fr": "eau tre ier que oi ment"}
    word = lambda x: "".join(rng.choice(syll[x].split()) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(x) for _ in range(15)), x) for i, x in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 4 <> 2"))
    out = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert sum(out[i].lang_pred == x for i, _, x in rows if i % 4 == 2) >= 44
    assert all(0 <= r.score <= 1 for r in out.values())
    seen = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= seen and len(seen) == 6
    assert language.identify(odd, language.train(none)).where("lang_pred = 'und'").count() == len(ODD)
    assert language.identify(none, model).count() == 0


def brute_segments(scores):
    """All maximal scoring subsequences by definition: the best stretch, then those left and right of it."""
    if not scores:
        return []
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            t = sum(scores[i:j])
            if t > best + 1e-9:
                best, at = t, (i, j)
    if at is None:
        return []
    i, j = at
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return left + [(i, j - 1, best)] + [(a + j, b + j, s) for a, b, s in right]


def test_segments_equal_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-0.5, -0.5, -0.5, rng.choice([0.7, 1.3, 2.1, -0.21, -1.13])]) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -0.5], 0.5)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want], scores
        assert all(math.isclose(x[2], y[2], abs_tol=1e-9) for x, y in zip(got, want, strict=True))


def test_toxicity_held_out_and_odd(spark, odd, none):
    rng = random.Random(4)
    words, bad = [f"w{i}" for i in range(200)], [f"bad{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(400):
        t = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            t[10:10] = rng.sample(bad, 4)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id % 3 <> 1"), lab.where("doc_id % 3 <> 1"))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert sum(out[i].predicted == labels[i][1] for i in held) >= len(held) - 3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    seen = toxicity.score_toxicity(odd, model).collect()
    assert len(seen) == len(ODD) and not any(r.predicted for r in seen)
    empty = toxicity.train(none, lab.where("false"))
    assert toxicity.score_toxicity(none, empty).count() == 0 and toxicity.score_toxicity(odd, empty).where("predicted = 1").count() == 0


def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    covered = {k for i, w in enumerate(wins) if n[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        w = [rng.choice("ab cd é#f $x <tag> h".split()) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and len(w) > 12:
            w = w + ["y"] * rng.randint(0, 3) + w[: rng.randint(8, 12)]
        texts.append("".join(x + rng.choice([" ", "  ", "\n", "\t", "  "]) for x in w))
    texts += [None, "", " \n ", "a " * 9, "a " * 3000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute_quality(t)
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), repr(t)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.kept and r.base_failed)


def test_quality_limits_adapt_to_source(spark, odd, none):
    clean = lambda k: " ".join(f"word{(i * 7 + k) % 97}" for i in range(80))
    rows = [(i, clean(i), "en", "prose") for i in range(60)] + [(100 + i, clean(i).replace("word", "#$w"), "en", "code") for i in range(60)] + [(999, clean(1).replace("word", "#$w"), "en", "prose")]
    out = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(60)) and all(out[100 + i] for i in range(60)) and not out[999]
    assert quality.quality_rules(odd).where("kept").count() == 0 and quality.quality_rules(odd).count() == len(ODD)
    assert quality.quality_rules(none).count() == 0


def test_quality_is_native(spark, odd):
    plan = quality.quality_rules(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lm_baseline_matches_counts_and_model_sums_to_one(spark, odd, none):
    rng = random.Random(8)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "A b c é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    learn = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) != 2)
    for most in (1000, 3):  # with few or most words joined
        out = {r.doc_id: r for r in lm.score_texts(docs, learn, max_frequent=most, merges=300).collect()}
        split = lambda t: [*(t or "").encode().lower().split(), lm.END]
        c = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
        total = sum(c.values())
        for i, t in enumerate(texts):
            ws, r = split(t), out[i]
            want = sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), total)
            assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0
    assert lm.score_texts(odd, odd, merges=300).count() == len(ODD)
    assert lm.score_texts(odd, none, merges=300).where("n_known = 0").count() == len(ODD)
    assert lm.score_texts(none, none, merges=300).count() == 0


def test_lm_probabilities_sum_to_one_and_windows_score_each_piece_once():
    t = lm.pieces_table(bpe.tokenizer_path(), 200)
    p = lm.train([b"ba be bi bo bu " * 20] * 5, t, steps=20, batch=8)
    m = lm.Model(p)
    m.fast()
    ids = np.arange(37) % (t["n"] - 1)
    x, y = lm.windows(np.r_[ids, t["n"] - 1], t["n"] - 1)
    assert y[y >= 0].tolist() == [*ids, t["n"] - 1]
    one = np.repeat(x[1:2], t["n"], 0)  # one context, every piece as target
    every = np.full((t["n"], lm.CHUNK), -1)
    every[:, 3] = np.arange(t["n"])
    assert abs((10 ** m.score(one, every)[:, 3]).sum() - 1) < 1e-3


def test_registry_names():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_lm_learns_from_all_texts_however_long_or_many(spark):
    long_only = spark.createDataFrame([(i, "ba be bi bo bu " * 1500) for i in range(3)], "doc_id long, text string")
    r = lm.score_texts(long_only, long_only, merges=300).first()
    assert r.score / r.n_tokens > -0.3  # no text of up to 20,000 bytes, yet fitted
    rare = [(i, "xylophon zebra" if i == 1999 else "ba be bi bo bu") for i in range(2000)]
    docs = spark.createDataFrame(rare, "doc_id long, text string")
    t = lm.pieces_table(bpe.tokenizer_path(), 300)
    p = lm.learned(docs, t, 10_000)
    seen = np.unique(np.r_[lm.pieces_of([b"xylophon", b"zebra", b"ba", b"be", b"bi", b"bo", b"bu"], t)[0], t["n"] - 1])
    assert np.flatnonzero(p["small"] < len(p["E"]) - 1).tolist() == seen.tolist()


def test_lm_rounds_fit_on_from_windows_that_grow_with_the_input(spark):
    docs = spark.createDataFrame([(i, "ba be bi bo bu " * 40) for i in range(60)], "doc_id long, text string")
    t = lm.pieces_table(bpe.tokenizer_path(), 300)
    one, two = lm.learned(docs, t, 10_000, steps=5, batch=4), lm.learned(docs, t, 10_000, steps=5, batch=4, rounds=0)
    assert np.isfinite(one["E"]).all() and not np.allclose(one["E"], two["E"])
    # A rerun gives the same parameters to the last digit.
    again = lm.learned(docs, t, 10_000, steps=5, batch=4)
    assert all(np.array_equal(one[a], again[a]) for a in one)


def test_lm_rounds_fit_all_windows_of_large_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"ba be bi bo bu xylo{i} " * 40) for i in range(60)], "doc_id long, text string").repartition(3)
    t = lm.pieces_table(bpe.tokenizer_path(), 300)
    rows = lm.piece_rows(docs, t, 1)
    every = rows.where("x is not null").count()
    assert rows.where("prev is null and c is not null").agg(F.sum("c")).first()[0] == every
    fitted = []

    def counting(texts, table_, p, cur, n, rate):
        fitted.append(sum(-(-(len(lm.pieces_of(r.t.encode().lower().split(), t)[0]) + 1) // lm.CHUNK) for r in texts.collect()))
        return p

    monkeypatch.setattr(lm, "averaged", counting)
    lm.learned(docs, t, 50_000_000, steps=5, batch=4)  # a table said to be large: few windows begin the fit
    assert len(fitted) == 2 and min(fitted) > 0 and sum(fitted) == every


def test_toxicity_slope_solves_its_equation():
    share, score = np.array([0.02, 0.01, 0.3]), np.array([1.5, 3.0, -0.4])
    x = toxicity.slope(share, score, 0.2)
    assert math.isclose((share * np.exp(x * score)).sum() + (1 - share.sum()) * math.exp(-0.2 * x), 1, abs_tol=1e-9)
    assert toxicity.slope(share[2:], score[2:], 0.2) == 1.0


def test_lm_base_score_of_one_training_document(spark):
    """The end and words seen once count, whether they are broadcast or joined."""
    docs = spark.createDataFrame([(1, "A b b c"), (2, "a b x"), (3, None)], "doc_id long, text string")
    counts, total, space = {b"a": 1, b"b": 2, b"c": 1, lm.END: 1}, 5, 5 + 4 + 1
    for most in (0, 1, 100):
        for r in lm.score_texts(docs, docs.where("doc_id = 1"), max_frequent=most, merges=300).collect():
            words = [*({1: "A b b c", 2: "a b x"}.get(r.doc_id, "").encode().lower().split()), lm.END]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), total)
            assert math.isclose(r.base_score, sum(math.log10((counts.get(w, 0) + 1) / space) for w in words), abs_tol=1e-9)


def test_lm_score_equals_a_plain_forward_pass():
    """Each position by itself, from the parameters alone."""
    t = lm.pieces_table(bpe.tokenizer_path(), 200)
    p = lm.train([b"ba be bi bo bu da de di " * 12] * 6, t, steps=30, batch=8)
    ids = np.r_[lm.pieces_of(b"be bo da zebra ba bi ba be bu de ba".split() * 3, t)[0], t["n"] - 1]
    x, y = lm.windows(ids, t["n"] - 1)
    m = lm.Model(p)
    m.fast()
    got, d = m.score(x, y), p["E"].shape[1]
    small = np.r_[p["small"], -1]
    for row in range(len(x)):
        ins, outs = small[x[row]], small[y[row]]
        e = [p["E"][i if i >= 0 else 0] + p["P"][j] for j, i in enumerate(ins)]
        for k in range(lm.CHUNK):
            if outs[k] < 0:
                assert got[row, k] == 0
                continue
            at = lm.BEFORE + k
            w = np.array([np.exp(e[at] @ p["Wq"] @ (e[j] @ p["Wk"]) / d**0.5) if ins[j] >= 0 else 0.0 for j in range(at + 1)])
            o = sum(a * (e[j] @ p["Wv"]) for j, a in enumerate(w / w.sum()))
            h = e[at] + o @ p["Wo"]
            z = h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]
            g = z @ p["Wc"] + p["B"][ins[at]] + p["B2"][ins[at - 1]]
            c = p["cls"][outs[k]]
            own = np.flatnonzero(p["cls"] == c)
            inner = p["U"][own] @ z + p["bu"][own]
            lp = g[c] - np.log(np.exp(g).sum()) + inner[list(own).index(outs[k])] - np.log(np.exp(inner).sum())
            lp -= p["share"] if outs[k] == len(p["E"]) - 1 else 0
            assert math.isclose(got[row, k], lp / np.log(10), abs_tol=2e-4)


def test_language_counts_long_words_whole(spark):
    long = ["a" * 60 + "x" * 30, "a" * 60 + "y" * 30]
    docs = spark.createDataFrame([(i, f"{long[i % 2]} {long[i % 2]}", "de" if i % 2 else "en") for i in range(20)], "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert out == {i: "de" if i % 2 else "en" for i in range(20)}


def test_lm_codes_whole_batches_as_single_texts():
    """Words, ends, pieces and windows of many texts at once are those of each text by itself; tables by size lose no row."""
    t = lm.pieces_table(bpe.tokenizer_path(), 300)
    texts = ["", None, "  \n\x0b ", "A\x1cb \x85 É x  aAa\ta", "ba " * 40, "a" * 999 + " b", "ba be zebra"] * 3
    batch = pa.table({"text": pa.array(texts, pa.string())})
    words, which, tokens, ids, first, sizes = lm.coded(batch.column(0), t)
    flat, per = lm.text_pieces(which, tokens, ids, first, sizes)
    x, y = lm.windows(flat, t["n"] - 1, per)
    names, at, row, piece = words.to_pylist(), 0, 0, 0
    assert len(set(names)) == len(names) and names[-1] == lm.END
    for text, n, m in zip(texts, tokens.tolist(), per.tolist(), strict=True):
        own = (text or "").encode().lower().split()
        assert [names[i] for i in which[at : at + n]] == [*own, lm.END]
        pieces = np.r_[lm.pieces_of(own, t)[0] if own else np.zeros(0, np.int64), t["n"] - 1]
        assert flat[piece : piece + m].tolist() == pieces.tolist()
        one, two = lm.windows(pieces, t["n"] - 1)
        assert (x[row : row + len(one)] == one).all() and (y[row : row + len(one)] == two).all()
        at, row, piece = at + n, row + len(one), piece + m
    assert (at, row, piece) == (len(which), len(x), len(flat))
    some = np.array([0, 2, len(x) - 1])
    a, b = lm.windows(flat, t["n"] - 1, per, some)
    assert (a == x[some]).all() and (b == y[some]).all()
    for size in (1, 300, 1 << 20):
        parts = list(lm.gathered(iter(batch.to_batches(max_chunksize=4)), size))
        assert [v for p in parts for v in p.column(0).to_pylist()] == texts
    assert list(lm.gathered(iter(batch.slice(0, 0).to_batches()), 1)) == []


def test_lm_sums_of_codes():
    codes, times = lm.added(np.array([5, 1, 5, 9, 1]), np.array([1, 2, 3, 4, 5]))
    assert codes.tolist() == [1, 5, 9] and times.tolist() == [7, 4, 4]


def test_lm_words_at_hand_are_not_merged_again(monkeypatch):
    t = lm.pieces_table(bpe.tokenizer_path(), 300)
    texts = pa.chunked_array([pa.array(["ba zebra be", None, "", "Xylophon ba ba bo", "é ba"])])
    plain, merge, seen = lm.coded(texts, t), bpe.merge_flat, []
    for known in ([lm.END], [lm.END, b"ba", b"never", b"zebra", b""], [b"ba", b"be", b"bo", b"zebra", b"xylophon", "é".encode()]):
        held = lm.with_words(t, known)
        monkeypatch.setattr(bpe, "merge_flat", lambda flat, sizes, table_: (seen.append(len(sizes)), merge(flat, sizes, table_))[1])
        got = lm.coded(texts, held)
        monkeypatch.undo()
        assert got[0].equals(plain[0]) and all(np.array_equal(a, b) for a, b in zip(got[1:], plain[1:], strict=True))
        assert sum(seen) == 6 - len({b"ba", b"be", b"bo", b"zebra", b"xylophon", "é".encode()} & set(known))
        seen.clear()


@pytest.mark.parametrize(("classes", "count"), [(4, 6), (1, 1)])  # the last: a class with more pieces than the batch has places
def test_lm_gradients_equal_differences_of_the_loss(classes, count):
    """All tables, over windows with absent inputs and targets, against the loss as scored."""
    t = lm.pieces_table(bpe.tokenizer_path(), 200)
    rng, n = np.random.default_rng(3), 40
    cls = rng.integers(0, classes, n)
    members = [np.flatnonzero(cls == c) for c in range(classes)]
    inside = np.zeros(n, np.int64)
    for m in members:
        inside[m] = np.arange(len(m))
    p = lm.start(rng.integers(1, 50, n).astype(float), rng.integers(0, 9, (n, classes)).astype(float), cls, rng)
    p["B2"] += rng.standard_normal(p["B2"].shape).astype(np.float32) * 0.1
    per = np.array([37, 1, 20])
    ids = rng.integers(0, n - 1, per.sum())
    ids[per.cumsum() - 1] = n - 1
    x, y = (w[:count] for w in lm.windows(ids, n - 1, per))
    some = np.arange(n)

    def loss(q):
        m = lm.Model(lm.finished(q, some, n))
        m.fast()
        return -m.score(x, y).sum() * np.log(10) / (y >= 0).sum()

    by_class = np.concatenate(members)
    now = {a: v for a, v in p.items() if a not in ("cls", "U", "bu")} | {"O": np.hstack([p["U"], p["bu"][:, None]])[by_class]}
    g = lm.gradients(now, x, y, cls.astype(np.uint16), inside, np.cumsum([0, *map(len, members)]).tolist())
    assert set(g) == set(now)
    for a, (rows, values) in g.items():
        full = np.zeros_like(now[a])
        full[rows] = values
        way = full / (np.linalg.norm(full) or 1)
        ends = []
        for step in (0.02, -0.02):
            q = {b: v.copy() for b, v in now.items()}
            q[a] += np.float32(step) * way
            q["U"], q["bu"] = np.empty_like(p["U"]), np.empty_like(p["bu"])
            q["U"][by_class], q["bu"][by_class] = q["O"][:, :-1], q["O"][:, -1]
            ends.append(loss(q | {"cls": cls}))
        assert math.isclose((ends[0] - ends[1]) / 0.04, np.linalg.norm(full), rel_tol=0.02, abs_tol=2e-4), a


def test_lm_group_sums():
    rng = np.random.default_rng(5)
    for rows, large in ((rng.integers(0, 9, 400), 40), (np.zeros(100, np.int64), 48), (np.arange(30), 48), (rng.zipf(1.5, 900) % 50, 20)):
        values = rng.standard_normal((len(rows), 7)).astype(np.float32)
        for n in (int(rows.max()) + 1, 1 << 17):
            order, cuts, named = lm.grouped(rows, n)
            want = np.zeros((int(rows.max()) + 1, 7))
            np.add.at(want, rows, values)
            assert named.tolist() == np.unique(rows).tolist() and np.allclose(lm.group_sums(values[order], cuts, large), want[named], atol=1e-4)
