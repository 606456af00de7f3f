r"""Quality rules in a ledger of bits: every rule is evaluated once, policies are applied later.

:func:`ledger` reads each text once and gives a row per document: its measurements, and ``failed``, a number whose bit b is set
when the rule with bit b failed. :func:`apply_policy` needs only the bits: a policy is a named, versioned list of rules, and a document is kept when it
fails none of them. :func:`ablations` tells for each rule of a policy what it does alone and what would be kept without it, from
the counts of the distinct bit patterns. A saved ledger serves any number of policies; neither reads a text again. Rules keep
their bits and conditions for ever; a changed rule is a new rule with a new bit.

Words are ``[^\x20\x09-\x0D]+``, as they stand. Lines are cut at \n; only lines with a word count. ``n_repeat_words`` are the words that lie in a window of
three words found twice or more in the text. Equal words, windows and lines are found by value.

Scale: one pass over the texts in slabs of a few megabytes, without a shuffle; the ledger is some ten numbers a document. Ablations shuffle one count for
each pattern of bits. A text longer than a slab is measured whole, in one piece.

Defined results: a null text has no words, like an empty one, and fails ``few_words`` (and ``few_letters`` never: a ratio of nothing fails no rule). A null
doc_id stays null. Repeated rows have a row each. An empty table gives an empty ledger and ablations of zeros. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import Scratch

#: Rules: bit and condition of failure, over the measurements.
RULES = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "100 * n_dup_lines > 30 * n_lines"),
    "few_letters": (4, "100 * n_letter_words < 80 * n_words"),
    "capitals": (5, "100 * n_capitals > 30 * word_chars"),
    "short_words": (6, "word_chars < 2 * n_words"),
    "long_words": (7, "word_chars > 20 * n_words"),
    "some_repeated_words": (8, "100 * n_repeat_words > 30 * n_words"),
}
#: Policies by name and version.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "prose-1": ("few_words", "repeated_words", "symbols", "repeated_lines", "few_letters", "capitals", "short_words", "long_words"),
    "prose-2": ("few_words", "repeated_words", "symbols", "repeated_lines", "few_letters", "capitals", "short_words", "long_words", "some_repeated_words"),
}
BASE, DEFAULT = "base-1", "prose-2"
SYMBOL = scan.byte_class("#*$%&|<>")
MEASURED = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capitals"]


def mask(policy: str | tuple) -> int:
    """The bits of a policy: a name in POLICIES or a list of rules."""
    return sum(1 << RULES[r][0] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeats(code: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text in windows of three that its words have twice or more."""
    window = scan.windows(code, text, 3)
    at = np.flatnonzero(window >= 0)
    order = at[np.lexsort((window[at], text[at]))]
    same = (window[order][1:] == window[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.unique(np.r_[order[1:][same], order[:-1][same]])
    covered = np.zeros(len(code), bool)
    for k in range(3):
        covered[twice + k] = True
    return np.bincount(text[covered], minlength=texts)


def _repeated_lines(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those of them that are equal to an earlier line) of each text."""
    start, end, text = scan.lines(raw, offsets)
    held = scan.between(scan.upto(inside), start, end) > 0
    start, end, text = start[held], end[held], text[held]
    n = np.bincount(text, minlength=len(offsets) - 1)
    if not len(text):
        return n, n
    code, _ = scan.codes(raw[scan.within(start, end, len(raw))], end - start)
    different = np.unique(text * (int(code.max()) + 1) + code) // (int(code.max()) + 1)
    return n, n - np.bincount(different, minlength=len(n))


def measure(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The MEASURED numbers of each text of a slab."""
    inside, lead = ~scan.SPACE[raw], scan.LEAD[raw]
    start, end, text = scan.words(inside, offsets)
    texts = len(offsets) - 1
    code, _ = scan.codes(raw[inside], end - start)
    lettered = scan.between(scan.upto(scan.LETTER[raw]), start, end) > 0
    n_lines, n_dup = _repeated_lines(raw, offsets, inside)
    count = lambda flags: scan.per_text(flags, offsets)
    return [
        np.bincount(text, minlength=texts), count(inside & lead), count(SYMBOL[raw]), n_lines, n_dup, _repeats(code, text, texts),
        np.bincount(text[lettered], minlength=texts), count(scan.CAPITAL[raw]),
    ]


def _measure(batches):
    for batch in batches:
        for rows, raw, offsets in scan.slabs(batch, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in measure(raw, offsets))], ["doc_id", *MEASURED])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and failed (long): the bits of all RULES that a document fails."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = plain.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURED))
    bits = [F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, condition in RULES.values()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def apply_policy(rows: DataFrame, policy: str | tuple = DEFAULT, name: str = "kept") -> DataFrame:
    """A ledger with a boolean column: whether a document fails no rule of the policy."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str | tuple = DEFAULT) -> DataFrame:
    """Of each rule of a policy: rule, n_failed, n_only (documents that fail no other rule), n_kept (by the policy), n_kept_without it.

    Ledger rows are counted by their bits first, combined before the shuffle; what is left is a count for each pattern.
    """
    whole, rules = mask(policy), POLICIES[policy] if isinstance(policy, str) else policy
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    alone = lambda r: total(F.col("bits") == F.lit(1 << RULES[r][0]))
    kept = total(F.col("bits") == 0)
    each = [
        F.struct(F.lit(r).alias("rule"), total(F.col("bits").bitwiseAND(F.lit(1 << RULES[r][0]).cast("long")) != 0).alias("n_failed"), alone(r).alias("n_only"), kept.alias("n_kept"), (kept + alone(r)).alias("n_kept_without"))
        for r in rules
    ]
    return counts.agg(F.array(*each).alias("each")).select(F.inline("each"))


def keep_good(docs: DataFrame, policy: str | tuple = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that fail no rule of the policy. Repeated rows and null ids are told apart by a saved number."""
    from .common import unused

    scratch, uid = Scratch(docs.sparkSession), unused(docs, "row")
    rows = scratch.numbered(docs, uid)
    bad = apply_policy(ledger(rows, uid, text_col), policy).filter("NOT kept").select(F.col("doc_id").alias(uid))
    return rows.join(bad, uid, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = Scratch(spark).save(ledger(docs))
    judged = apply_policy(apply_policy(stored, BASE, "base_passed"), DEFAULT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_passed")).alias("base_failed"), "kept", "n_lines", "n_letter_words", "n_capitals", "failed")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(ls) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]')))::BIGINT AS n_letter_words,
  length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, (CONDITIONS)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & BASE <> 0 AS base_failed, failed & POLICY = 0 AS kept, n_lines, n_letter_words, n_capitals, failed FROM f
""".replace("CONDITIONS", " + ".join(f"CASE WHEN {condition} THEN {1 << bit} ELSE 0 END" for bit, condition in RULES.values())).replace("BASE", str(mask(BASE))).replace("POLICY", str(mask(DEFAULT)))
