"""Secrets that the pattern gates of the first round left out."""

import random

from siftwire.llm import secrets


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.secrets for r in secrets.scan_secrets(docs, secrets.train(docs)).orderBy("doc_id").collect()]


def test_letters_only_parts_of_runs_and_no_labelled_secret(spark):
    rng = random.Random(5)
    rand = lambda n, c: "".join(rng.choice(c) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    letters = low + low.upper()
    names = ["number_of_ordinary_words", "numberOfOrdinaryWords", "/plain/words/of/ordinary/text", "PLAIN_WORDS_OF_TEXT_2", "=" * 30]
    plain = [f"plain words of ordinary text, number {i} {rng.choice(names)} " * 3 for i in range(200)]
    keys = [rand(24, letters) for _ in range(5)]
    one, two = rand(24, letters), rand(24, letters)
    stretch = rand(20, "0123456789abcdef")
    long = f"{one}Z{stretch}Z{two}"
    texts = [*plain, *(f"the value {k} stands alone" for k in keys), f"and {long} too"]
    for marked in ([], [f"password={rand(20, letters + '0123456789')}" for _ in range(30)]):
        out = found(spark, [*texts, *marked])
        assert not any(out[: len(plain)])
        assert [o for o in out[len(plain) : len(plain) + 5]] == [[k] for k in keys]
        rest = out[len(plain) + 5]
        assert len(rest) == 3 and "".join(rest) == long and stretch in rest[1]
