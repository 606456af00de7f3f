"""Language identification by a bidirectional gated recurrent network over bytes (see recurrent.py).

The network is trained in numpy on the driver, by backpropagation through time, on windows of the whole texts of a bounded sample of
labelled rows (``rows_per_language`` of each language, whatever their number, the ones with the smallest hashes of doc_id). Then every
text is read whole: cut into segments of ``SEGMENT`` bytes that the network reads from both sides, many at a time; every
position is labelled with probabilities, and a document's are the means over its letters.

Scale: one pass over the texts without a shuffle. The model, some tens of kB, is all that is sent to the executors.

Defined results: a text that is null or has no letter is ``und`` with score 0. Labels that are null are not learned from.
Without any labelled row all texts are ``und``. Repeated rows are labelled each; further columns are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .recurrent import ByteGRU

SEGMENT, WINDOW = 128, 64
#: Segments that the network reads at a time.
WIDE = 2048
#: Letters of any script (Unicode category L).
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are letters or parts of characters beyond ASCII.
LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Windows that cover all of a text's bytes."""
    raw = text.encode("utf-8", "surrogatepass").replace(b"\0", b" ")
    return [raw[s : s + size] for s in range(0, max(1, len(raw)), size)]


def padded(parts: list[bytes], size: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(-1, size)


def train(sample: list[tuple[str, str]], hidden: int = 8, rounds: int = 300, seed: int = 0) -> tuple[ByteGRU, list[str]]:
    """A network and its languages from (text, language) pairs."""
    languages = sorted({lang for _, lang in sample})
    parts, labels = [], []
    for text, lang in sample:
        for w in windows(text):
            parts.append(w)
            labels.append(languages.index(lang))
    x, y = padded(parts, WINDOW), np.array(labels)
    # Each language has the same weight.
    pick = np.concatenate([np.random.default_rng(seed).choice(np.flatnonzero(y == c), 4000) for c in range(len(languages))])
    net = ByteGRU(len(languages), hidden, seed)
    net.known = np.bincount(x.ravel(), minlength=256) > 0
    net.train(x[pick], y[pick], LETTERS[x[pick]].astype(np.float32) * (x[pick] > 0), rounds, seed=seed)
    return net, languages


def pooled(net: ByteGRU, texts: list[str | None]) -> np.ndarray:
    """(texts, classes): mean probabilities over the letters of each whole text; nan where there is none.

    A letter of bytes that no text learned from has speaks for no language, and lowers all means.
    """
    out, counts = np.zeros((len(texts), net.classes)), np.zeros(len(texts))
    parts: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        if not parts:
            return
        x = np.ascontiguousarray(padded(parts, SEGMENT).T)
        letters = LETTERS[x] & (x > 0)
        p = net.probabilities(x)
        p *= (letters & net.known[x])[:, None, :]
        own = np.array(owner)
        for c, row in enumerate(p.sum(axis=0)):
            out[:, c] += np.bincount(own, row, len(texts))
        counts[:] += np.bincount(own, letters.sum(axis=0), len(texts))
        parts.clear()
        owner.clear()

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").replace(b"\0", b" ")
        for a in range(0, len(raw), SEGMENT):
            parts.append(raw[a : a + SEGMENT])
            owner.append(i)
            if len(parts) == WIDE:
                flush()
    flush()
    with np.errstate(invalid="ignore"):
        return out / counts[:, None]


def _predict(net: ByteGRU, languages: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = pooled(net, texts)
            none = np.array([not t or not _LETTER.search(t) for t in texts], bool) | np.isnan(p).any(axis=1)
            p[none] = 0
            best = p.argmax(axis=1) if len(texts) else np.empty(0, int)
            lang = ["und" if n else languages[b] for n, b in zip(none, best, strict=True)]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(p.max(axis=1).clip(0, 1), pa.float64())], [*keep, "lang_pred", "score"])

    return run


def labelled_sample(docs: DataFrame, label: str, rows_per_label: int) -> list[tuple[str, str]]:
    """(text, label) of at most rows_per_label rows of each label, by the smallest hashes of doc_id. Of rows that are repeated in it one is returned."""
    rows = docs.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("label"), "doc_id", "text")
    key = F.xxhash64("label", "doc_id", "text")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    narrow = rows.select("label", "doc_id", key.alias("key")).withColumn("nth", F.row_number().over(order))
    keys = [r["key"] for r in narrow.filter(F.col("nth") <= rows_per_label).select("key").distinct().collect()]
    got = rows.withColumn("key", key).filter(F.col("key").isin(keys)).groupBy("key").agg(*(F.first(c).alias(c) for c in rows.columns)).collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["label"], r["text"]))]


def identify(docs: DataFrame, labelled: DataFrame, rows_per_language: int = 300, hidden: int = 8, rounds: int = 300, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score. labelled (doc_id, text, lang): what may be learned from."""
    sample = labelled_sample(labelled, "lang", rows_per_language)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    names = [f.name for f in docs.schema.fields if f.name in keep]
    if not any(_LETTER.search(t) for t, _ in sample):
        return docs.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    net, languages = train(sample, hidden, rounds)
    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(_predict(net, languages), f"{schema}, lang_pred string, score double")


#: Letters from which on a text must have the whole score.
ENOUGH = 64


def least_of(languages: int) -> float:
    """The score below which a long text is in none of so many languages."""
    return 0.25 + 0.6 / languages


def _keep(net: ByteGRU, languages: list[str], text: str, least_score: float):
    chance = min(least_score, 1 / len(languages))

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            p, good = pooled(net, texts), []
            for t, x in zip(texts, p, strict=True):
                letters = sum(1 for _ in islice(_LETTER.finditer(t or ""), ENOUGH))
                # A few letters say little: from them no more is asked than what chance gives.
                good.append(bool(letters and not np.isnan(x[0]) and x.max() >= chance + (least_score - chance) * letters / ENOUGH))
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def keep_identified(docs: DataFrame, labelled: DataFrame, least_score: float | None = None, text_col: str = "text", rows_per_language: int = 300, hidden: int = 8, rounds: int = 300) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in a language with a score of at least least_score (see least_of).

    What has no letter is rejected, what is mostly in a script that no labelled row has, and what the network is unsure about. Of texts with fewer
    than ENOUGH letters a lower score is asked, down to what chance gives. Without any labelled row nothing can be identified and nothing is kept.
    """
    sample = labelled_sample(labelled, "lang", rows_per_language)
    if not any(_LETTER.search(t) for t, _ in sample):
        return docs.filter(F.lit(False))
    net, languages = train(sample, hidden, rounds)
    return docs.mapInArrow(_keep(net, languages, text_col, least_of(len(languages)) if least_score is None else least_score), docs.schema)


def held_out(doc_id=None):
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id is never learned from."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op1(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.filter(~held_out()).select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), labelled).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
