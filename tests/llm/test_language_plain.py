"""Operator 3 against a plain version of its words and backoff."""

import math
import random
import re
from collections import Counter

import numpy as np

from siftwire.llm import language

FIND = re.compile(r"[^\W\d_]+").findall


def pieces(word, n):
    word = f"\x02{word}\x03"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def plain(train, texts, longest=5):
    """Guesses of `texts` by words that stand twice or more in `train` (text, lang), else by their longest n-grams that do."""
    langs = sorted({x for _, x in train})
    words, grams = Counter(), Counter()
    for text, lang in train:
        for w in FIND(text.lower()):
            words[w, lang] += 1
            for n in range(1, longest + 1):
                for g in pieces(w, n):
                    grams[g, lang] += 1

    def table(counts, size):
        totals = Counter()
        for (item, lang), k in counts.items():
            totals[size(item), lang] += k
        items = {item for item, _ in counts}
        kept = {i for i in items if sum(counts[i, x] for x in langs) >= 2}
        return {i: [math.log10((counts[i, x] + 0.1) / (totals[size(i), x] + 0.1 * len(kept))) for x in langs] for i in kept}

    known, parts = table(words, lambda _: 0), table(grams, len)

    def score(w):
        if w in known:
            return known[w]
        for n in range(min(longest, len(w) + 2), 0, -1):
            found = [parts[g] for g in pieces(w, n) if g in parts]
            if found:
                return np.mean(found, axis=0)
        return [0.0] * len(langs)

    out = []
    for text in texts:
        ws = FIND((text or "").lower())
        if not any(c.isalpha() for w in ws for c in w):
            out.append(("und", 0.0))
            continue
        mean = np.mean([score(w) for w in ws], axis=0)
        p = np.exp((mean - mean.max()) * min(len(ws), 20) * np.log(10))
        out.append((langs[int(p.argmax())], float(p.max() / p.sum())))
    return out


def test_guesses_equal_a_plain_version(spark):
    rng = random.Random(5)
    syll = {"en": "the ing tion ed er an", "de": "der sch ung ein ich keit", "fr": "eau tre ier que oi ment"}
    word = lambda x: "".join(rng.choice(syll[x].split()) for _ in range(rng.randint(1, 4)))
    rows = [(" ".join(word(x) for _ in range(rng.randint(1, 12))), x) for x in ["en", "de", "fr"] * 25]
    texts = [" ".join(word(rng.choice("en de fr".split())) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [None, "", "12 _ ?", "½ ² Ⅷ ①", "zz½", "qqqq xx", "The DER"]
    model = language.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    for i, (lang, score) in enumerate(plain(rows, texts)):
        assert abs(got[i][1] - score) < 1e-4 and (got[i][0] == lang or abs(score - 0.5) < 1e-3), (texts[i], got[i], lang, score)
    assert [got[len(texts) - k][0] for k in (7, 6, 5, 4)] == ["und"] * 4
