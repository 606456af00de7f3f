"""Nothing of a copy is left over by substring deduplication, and no two texts are taken for one by their form."""

import random

from fixtures import sentence, text

from nimbogrid.llm import substring_dedup


def removed(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(d, short_words=16).collect()}


def test_copies_of_16_words_lose_all_bytes(spark):
    rng = random.Random(4)
    texts = [text(rng, rng.choice(["en", "de", "fr"]), rng.randint(2, 12)) for _ in range(40)]
    texts += [" ".join(sentence(rng, words=1).strip(".").lower() for _ in range(n)) for n in (16, 17, 40, 41, 90, 400)]
    texts += [f" \n -- {texts[0]} ...\n--\n", f"a, b, c, d. {texts[1]} e; f", "1 2 3 4 5 6 7 8, 9 10 11 12 13 14 15 16", f"{' '.join(map(str, range(16)))}! ... !"]
    texts = [t for t in texts if len(t.split()) >= 16]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    n = removed(spark, rows)
    assert [n[1000 + i] for i in range(len(texts))] == [len(t.encode()) for t in texts]


def test_words_of_one_polynomial_hash_stay(spark):
    """The sequence that is its own complement under every polynomial modulo a power of two, as letters of a word and as words."""
    bits = [bin(k).count("1") & 1 for k in range(4096)]
    rest = " ".join(f"word{k}" for k in range(40))
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    c, d = (" ".join(("left", "right")[x ^ flip] for x in bits[:2048]) for flip in (0, 1))
    n = removed(spark, [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, c), (4, d)])
    assert n[1] == n[3] == 0 and n[2] <= len(rest) + 1 and n[4] < len(d)
