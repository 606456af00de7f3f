"""Quality rules, phrase collocations and the filter audit against plain Python, with odd cases, and against SQL."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import connect, same
from fixtures import corpus, frame, text

from nimbogrid.llm import collocations, filter_audit, quality_rules, scan
from nimbogrid.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (7000, "a b c a b c a b c x"), (7001, "same line here\nsame line here\n\n \nsame line here\r\n"), (7002, "ÄÖ é é x # $ % &| <>*"), (7003, "\n\n"), (7004, "w" * 90_000), (7005, "a " * 40_000),
    (7006, "one two three. One two three, one\vtwo three"), (None, "null id"), (None, None), (7007, "THE BIG ONE\n" * 30), (7008, "日本 語。日本 語"),
]


def rows():
    return corpus(3) + ODD


def measured(t):
    t = t or ""
    w = WORDS.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(inside), letters, len(re.findall("[A-Z]", t)))


def key(r):
    return tuple((x is None, 0 if x is None else x) for x in r)


def test_ledger_of_odd_texts(spark):
    got = quality_rules.ledger(frame(spark, rows(), extra=True)).collect()
    want = [(i, *measured(t)) for i, t in rows()]
    assert sorted((tuple(r)[:9] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert (r["failed"] & 1 == 1) == (r["n_words"] < 50) and (r["failed"] & 2 == 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_policies_and_ablations(spark):
    book = quality_rules.ledger(frame(spark, rows())).cache()
    failed = [r["failed"] for r in book.collect()]
    for policy in ("base-1", "prose-1", ("symbols", "capitals")):
        whole = quality_rules.mask(policy)
        kept = [f & whole == 0 for f in failed]
        assert Counter(r["kept"] for r in quality_rules.apply_policy(book, policy).collect()) == Counter(kept)
        for r in quality_rules.ablations(book, policy).collect():
            bit = 1 << quality_rules.RULES[r["rule"]][0]
            assert r["n_failed"] == sum(bool(f & bit) for f in failed) and r["n_only"] == sum(f & whole == bit for f in failed)
            assert r["n_kept"] == sum(kept) and r["n_kept_without"] == sum(f & whole & ~bit == 0 for f in failed)
    assert len({b for b, _ in quality_rules.RULES.values()}) == len(quality_rules.RULES)


def test_rules_keep_all_columns_and_empty_tables(spark):
    d = frame(spark, rows(), extra=True)
    kept = quality_rules.keep_good(d, "base-1")
    assert kept.columns == d.columns
    ok = lambda t: (lambda m: m[0] >= 50 and 100 * m[5] <= 50 * m[0])(measured(t))
    assert kept.count() == sum(ok(t) for _, t in rows()) > 0
    empty = frame(spark, [])
    assert quality_rules.ledger(empty).count() == 0
    assert {r["n_failed"] for r in quality_rules.ablations(quality_rules.ledger(empty)).collect()} == {0}


def test_slabs_change_nothing(monkeypatch):
    texts = pa.array([t for _, t in rows()])
    batch = pa.RecordBatch.from_arrays([texts], ["text"]).slice(3)
    once = [np.concatenate(x) for x in zip(*(quality_rules.measure(raw, at) for _, raw, at in scan.slabs(batch, "text", 1 << 30)))]
    parts = [np.concatenate(x) for x in zip(*(quality_rules.measure(raw, at) for _, raw, at in scan.slabs(batch, "text", 500)))]
    assert len(list(scan.slabs(batch, "text", 500))) > 5 and all((a == b).all() for a, b in zip(once, parts, strict=True))
    masks = [np.concatenate([filter_audit.masks(raw, at) for _, raw, at in scan.slabs(batch, "text", n)]) for n in (500, 1 << 30)]
    assert (masks[0] == masks[1]).all()


def test_colliding_hashes_do_not_merge_words():
    words = ["ab", "cd", "ab", "cde", "x", "cd", "x", "y"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, own = scan.words(~scan.SPACE[raw], np.array([0, 12, len(raw)]))
    for hashes in (np.zeros(len(words), np.uint64), np.array([1, 1, 1, 1, 2, 1, 2, 2], np.uint64)):
        assert scan.distinct_words(raw, start, end, own, 2, hashes).tolist() == [len(set(words[:4])), len(set(words[4:]))]


def brute_collocations(docs, longest, least, most):
    f, n = {}, Counter()
    for t, lang in docs:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] = f.get((lang or "und", tuple(w[i : i + m])), 0) + 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(other == lang and len(q) > len(p) and 100 * b >= 50 * a and inside(q) for (other, q), b in found.items()):
            continue
        score, _, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1))


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(5)
    docs = [(text(rng, k or "fr", 30), k) for k in ("en", "de", None) for _ in range(15)]
    docs += [("New York City is big. NEW york city, new york", k) for k in ("en", None, "und") for _ in range(6)]
    docs += [(None, "en"), ("", None), (" \t", "x"), ("one", "y"), ("a a a a a a a a a a a a a a", "z"), ("p q r s. " * 12 + "é ü ö\v" * 11, "w"), ("# #\t# 1 , 1\r\n1 1 " * 9, "w")]
    return docs


@pytest.mark.parametrize(("longest", "least", "most"), [(3, 10, 2000), (3, 3, 7), (2, 4, 50), (4, 5, 2000)])
def test_collocations(spark, phrases, longest, least, most):
    d = spark.createDataFrame(phrases, "text string, lang string").selectExpr("*", "1 AS word", "2 AS number", "3 AS rank").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(d, longest, least, most).collect())
    assert got == brute_collocations(phrases, longest, least, most) and got


def test_hot_prefixes_and_salted_groups(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "HOT", 0.01)
    monkeypatch.setattr(collocations, "SLABS", 1)
    monkeypatch.setattr(collocations, "GROUP_BYTES", 4000)
    d = spark.createDataFrame(phrases, "text string, lang string").repartition(7)
    assert sorted(tuple(r) for r in collocations.collocations(d, 3, 3).collect()) == brute_collocations(phrases, 3, 3, 2000)


def test_no_phrases(spark):
    for docs in ([], [(None, None)], [("a b", "en")]):
        assert collocations.collocations(spark.createDataFrame(docs, "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], "text string, lang string"), longest=1)


def test_scores_are_exact_beyond_64_bits(spark):
    """Counts whose products need more than 64 bits."""
    a, left, right = 9_876_543_210, 98_765_432_109, 87_654_321_098
    found = spark.createDataFrame([([1, 2], a)], "ids array<long>, a long")
    words = spark.createDataFrame([(1, "en", b"x", left), (2, "en", b"y", right)], "number long, lang string, word binary, f long")
    assert collocations.scores(found, words).first()["score"] == 1_000_000 * a * a // (left * right)


def test_audit_by_walking_every_order(spark):
    rng = random.Random(2)
    docs = [(i, t, rng.choice(["s0", "s1", None, ""])) for i, t in rows()]
    docs += [(8000 + i, " ".join(f"W{rng.randrange(900)}" for _ in range(60)), "s2") for i in range(5)] + [(8100, "# # #", "s2"), (8100, "# # #", "s2"), (8101, "# # #", None)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in docs if r[0] is not None for _ in range(rng.choice([0, 1, 1, 2]))]
    d = spark.createDataFrame([(i, t, s, 1) for i, t, s in docs], "doc_id long, text string, source string, mask int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scratch = Scratch(spark)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(filter_audit.failures(d, scratch), lab).collect()}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))

    def fails(i, t):
        t = t or ""
        w = WORDS.findall(t)
        return {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}

    want = {}
    for part in {s or "" for *_, s in docs}:
        own = [(i, fails(i, t)) for i, t, s in docs if (s or "") == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone, left = [x for x in left if x[1][letter]], [x for x in left if not x[1][letter]]
                shapley[letter] += len(gone)
                only = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                want[part, order, step] = (len(left), len(gone), sum(f[letter] for _, f in own) - len(gone), only, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for p, order, step in list(want):
            if p == part:
                want[p, order, step] = (*want[p, order, step][:6], shapley[order[step - 1]])
    assert got == want and len(got) == 600 * len({s or "" for *_, s in docs})
    assert filter_audit.audit(filter_audit.failures(d.limit(0), scratch), lab).count() == 0


@pytest.mark.parametrize(("op", "sql"), [(quality_rules.op11, quality_rules.OP11_SQL), (collocations.op12, collocations.OP12_SQL), (filter_audit.op13, filter_audit.OP13_SQL)])
def test_equals_sql(spark, sf, op, sql):
    same(op(spark, sf), connect(sf), sql)
    assert isinstance(duckdb.__version__, str)
