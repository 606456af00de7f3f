"""Small corpora with every awkward case, and brute-force versions."""

from __future__ import annotations

import random

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st".split(), "de": "sch ung ver ge ein er te ß ä ü ö heit keit lich zu auf pf".split(), "fr": "eau eux ai oi ou é è ê ç tion ment aux que re le la vi".split()}


def sentence(rng: random.Random, lang: str = "en", words: int = 9) -> str:
    w = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w).capitalize() + "."


def text(rng: random.Random, lang: str = "en", sentences: int = 8) -> str:
    return " ".join(sentence(rng, lang, rng.randint(4, 12)) for _ in range(sentences))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, blank and very long texts, repeated rows. Null ids are in test_contracts."""
    rng = random.Random(seed)
    rows: list[tuple] = [(i, text(rng, rng.choice(["en", "de", "fr"]), rng.randint(2, 14))) for i in range(n)]
    passage = text(rng, "en", 7)
    for i in range(0, n, 6):
        rows[i] = (i, rows[i][1][:50] + passage + rows[i][1][50:])
    rows += [(1000 + i, rows[i][1]) for i in range(0, n, 5)]  # copies
    rows += [(2000 + i, rows[i][1].replace(" ", "\n", 2) + "  ") for i in range(0, n, 7)]  # equal but for white space
    rows += [(3000 + i, rows[i][1].replace("a", "e", 1)) for i in range(0, n, 8)]  # nearly equal
    rows += [(4000, None), (4001, ""), (4002, " \n\t"), (4003, None), (4004, "...!!"), (4005, "a"), (4006, "é"), (4007, "日本語 の テキスト")]
    rows += [(4010, text(rng, "en", 900)), (4011, "ab" * 3000), (4012, "x" * 700)]
    rows += [rows[3], rows[3], rows[-1]]  # repeated rows
    return rows


def frame(spark, rows, extra: bool = False):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:  # names that operators use inside
        for c in ("uid", "level", "name", "name_", "range", "size", "h1", "kept", "fp", "batch", "part", "score", "lang_pred", "rank"):
            d = d.selectExpr("*", f"doc_id as {c}")
    return d


def saved(spark, rows, path, extra: bool = False):
    """As a table, which gives the same rows in the same order whenever it is read."""
    frame(spark, rows, extra).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))
