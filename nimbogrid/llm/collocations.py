r"""Phrase collocations by growing contiguous patterns to the right, one task for each prefix.

Texts in lower case (A-Z) are split at ``[.,;:!?\x0A-\x0D]`` into pieces and these into words ``[^\x20\x09]+``; everything is counted per language.
The words that occur ``least`` times or more are the first prefixes. The occurrences of a prefix are projected: each sends the words that follow it in its
piece, as far as they are frequent themselves (what follows an infrequent word is in no frequent phrase). A prefix's task sorts its projected occurrences, so that those of every
longer prefix are one range of it, and goes depth first: the next words in a range that occur ``least`` times or more are emitted as phrases, and their ranges are grown in turn.

Cutting a phrase after its first k words gives score floor(1000000 * a * a / (l * r)); the lowest cut counts. A candidate that lies in a longer candidate with half of its
occurrences or more is dropped. Products are decimals of 38 digits: exact for counts up to 10**15.

Scale: a text is read once and kept as the numbers of its words in its slab. Words meet their frequencies, and phrases their parts, in joins; no vocabulary is
broadcast. Equal projections of a slab are sent once, with their number. A prefix with more occurrences than ``HOT`` times what a task has on average is divided among the tasks of its longer prefixes of two words, and of any task's
projections those of equal words are added up in salted groups first when there are more than ``SLABS`` slabs, so that a task holds different continuations, not occurrences: what it holds of one pair of
words is bounded by the vocabulary. Ranks come from a range sort over all candidates and the counts of its partitions, without a window over a language's rows.

Defined results: a null text is empty, a null language ``und``, together with rows of a language of that name. Repeated rows count each. Texts without words, and an empty table, give no phrases. A piece of one word has no phrase.
Words of any length count; phrases order by the bytes of their UTF-8. A text longer than a slab is a slab of its own. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .common import Scratch, groups_for
from .hashing import mix
from .scan import SLAB

#: What ends a piece, and what else separates words.
MARKS = scan.byte_class(".,;:!?\n\v\f\r")
BLANK = scan.byte_class(" \t")
#: Occurrences of a first word, in shares of a task's average, beyond which its second words have tasks of their own; bytes of a task's projections; slabs without salt.
HOT, GROUP_BYTES, SLABS = 0.25, 16 << 20, 4096
SCORED = 1_000_000
SLAB_DDL = "slab long, codes binary, langs array<string>, words array<binary>, counts array<long>"


def _slabs(batches):
    """A row for each slab: its sequence of word numbers (-1 between pieces), and of each number the language, word and count."""
    from pyspark import TaskContext

    slab = TaskContext.get().partitionId() << 32
    for batch in batches:
        for rows, raw, offsets in scan.slabs(batch, "text", SLAB):
            row = _slab(slab, rows.column("lang"), raw, offsets)
            if row is not None:
                yield row
                slab += 1
                del row
            pa.default_memory_pool().release_unused()


def _slab(slab: int, lang: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
    lower = raw | (np.uint8(32) * scan.CAPITAL[raw])
    start, end, text = scan.words(~(MARKS | BLANK)[lower], offsets)
    if not len(start):
        return None
    # A piece ends between two words where a mark or the end of a text stands.
    apart = (text[1:] != text[:-1]) | (scan.between(scan.upto(MARKS[lower]), end[:-1], start[1:]) > 0)
    word, names = scan.codes(lower[scan.within(start, end, len(lower))], end - start)
    del start, end, lower
    langs = lang.dictionary_encode()
    text = langs.indices.to_numpy()[text].astype(np.int64)
    text *= len(names)
    text += word
    del word
    held, code, n = np.unique(text, return_inverse=True, return_counts=True)
    del text
    line = np.full(len(code) + int(apart.sum()), -1, np.int32)
    line[np.arange(len(code)) + np.r_[0, np.cumsum(apart)]] = code
    del code, apart
    column = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    spelled = names.take(pa.array(held % len(names))).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([slab], pa.int64()), pa.array([line.tobytes()], pa.binary()), column(langs.dictionary.take(pa.array(held // len(names)))), column(spelled), column(pa.array(n, pa.int64()))],
        ["slab", "codes", "langs", "words", "counts"],
    )


def _projected(parts: int, salts: int, longest: int, kind: str):
    """Of a slab, the projections of its frequent words: (prefix, following words) with their number, dealt by prefix."""

    def run(key, slabs: pa.Table, found: pa.Table) -> pa.Table:
        rows, salt = [], int(key[0].as_py()) % 1_000_003 % salts
        line = np.frombuffer(slabs.column("codes")[0].as_buffer(), np.int32) if len(slabs) else np.empty(0, np.int32)
        if len(found) and len(line):
            # Number in the slab -> number of the word in the corpus, and whether it is hot; 0 is none.
            size = int(line.max()) + 1
            number, hot = np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)
            at = found.column("code").to_numpy()
            number[at], hot[at] = found.column("number").to_numpy(), found.column("hot").to_numpy()
            follow = [np.r_[number[line[k:]], np.zeros(k, np.int64)] for k in range(longest)]
            for k in range(1, longest):
                follow[k][follow[k - 1] == 0] = 0
            begins = (follow[0] > 0) & (follow[1] > 0)
            follow, is_hot = [f[begins] for f in follow], hot[line[begins]]
            order = np.lexsort(follow[::-1])
            follow = [f[order] for f in follow]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for f in follow:
                new[1:] |= f[1:] != f[:-1]
            first = np.flatnonzero(new)
            n = np.diff(np.r_[first, len(order)])
            follow, is_hot = [f[first] for f in follow], is_hot[order][first]
            prefix = mix(follow[0].astype(np.uint64))
            prefix = np.where(is_hot, mix(prefix + follow[1].astype(np.uint64)), prefix)
            rows = _dealt((prefix % np.uint64(parts)).astype(np.int64), salt, [*follow, n], kind)
        return _packed(rows, longest)

    return run


def _dealt(part: np.ndarray, salt: int, columns: list[np.ndarray], kind: str) -> list[tuple]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else [0]
    columns = [c[order].astype(k) for c, k in zip(columns, [kind] * (len(columns) - 1) + ["<i8"], strict=True)]
    return [(int(part[a]), salt, *(c[a:b].tobytes() for c in columns)) for a, b in zip(cut, cut[1:], strict=False)]


def _packed(rows: list[tuple], longest: int) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * (longest + 3)
    names = ["part", "salt", *(f"w{k}" for k in range(longest)), "n"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int32(), *[pa.binary()] * (longest + 1)], strict=True)], names=names)


def _added(table: pa.Table, longest: int, kind: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The different projections of a group in the order of their words, and how often each occurs."""
    columns = [np.frombuffer(b"".join(table.column(f"w{k}").to_pylist()), kind) for k in range(longest)]
    n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<i8")
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n, first)


def grow(columns: list[np.ndarray], n: np.ndarray, least: int) -> tuple[list[list[int]], list[int]]:
    """Frequent phrases of two words or more, depth first, of sorted projections: (words, occurrences)."""
    phrases, counts = [], []
    sums = np.r_[0, np.cumsum(n)]
    # (words, range of its occurrences, whether these are of one first word)
    stack: list[tuple[list[int], int, int]] = [([], 0, len(n))]
    while stack:
        words, a, b = stack.pop()
        if len(words) == len(columns):
            continue
        nexts = columns[len(words)][a:b]
        cut = np.r_[a, a + 1 + np.flatnonzero(nexts[1:] != nexts[:-1]), b]
        total = sums[cut[1:]] - sums[cut[:-1]]
        frequent = np.flatnonzero((total >= least) & (columns[len(words)][cut[:-1]] > 0)) if b > a else []
        for k in frequent:
            longer = [*words, int(columns[len(words)][cut[k]])]
            if len(longer) > 1:
                phrases.append(longer)
                counts.append(int(total[k]))
            stack.append((longer, int(cut[k]), int(cut[k + 1])))
    return phrases, counts


def _mine(longest: int, least: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        phrases, counts = grow(*_added(table, longest, kind), least)
        return pa.table({"ids": pa.array(phrases, pa.list_(pa.int64())), "a": pa.array(counts, pa.int64())})

    return run


def _combined(longest: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        columns, n = _added(table, longest, kind)
        part = table.column("part")[0].as_py()
        return _packed(_dealt(np.full(len(n), part), 0, [*columns, n], kind), longest)

    return run


def numbered_words(slabs: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, totals): number (from 1, gapless), lang, word, f of each frequent word; n, the occurrences of all words of each lang."""
    counts = slabs.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("w")).select("w.*").groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    counts = scratch.save(counts)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = scratch.save(counts.filter(F.col("f") >= least).withColumn("row", F.monotonically_increasing_id()))
    partition = F.shiftright("row", 33)
    before = frequent.groupBy(partition.alias("p")).agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    words = frequent.withColumn("p", partition).join(before, "p").select((F.coalesce("before", F.lit(0)) + F.col("row") - F.shiftleft("p", 33) + 1).alias("number"), "lang", "word", "f")
    return scratch.save(words), scratch.save(totals)


def phrase_counts(docs: DataFrame, scratch: Scratch, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): ids (numbers of two to longest words), a of each frequent phrase; the tables of :func:`numbered_words`."""
    spark = docs.sparkSession
    plain = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    slabs = scratch.save(plain.mapInArrow(_slabs, SLAB_DDL), "zstd")
    words, totals = numbered_words(slabs, scratch, least)
    n_slabs, size = slabs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("codes")), F.lit(0))).first()
    kind = "<u4" if words.count() < (1 << 32) - 1 else "<i8"
    parts, salts = groups_for(spark, size * longest, GROUP_BYTES), -(-n_slabs // SLABS) or 1
    hot = HOT * (totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / parts
    own = slabs.select(F.col("slab").alias("of"), F.posexplode(F.arrays_zip("langs", "words")).alias("code", "w")).select("of", "code", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    found = own.join(words.select("lang", "word", "number", (F.col("f") > hot).alias("hot")), ["lang", "word"]).select("of", "code", "number", "hot")
    ddl = "part int, salt int, " + ", ".join(f"w{k} binary" for k in range(longest)) + ", n binary"
    dealt = slabs.select("slab", "codes").groupBy("slab").cogroup(found.groupBy("of")).applyInArrow(_projected(parts, salts, longest, kind), ddl)
    if salts > 1:
        dealt = dealt.groupBy("part", "salt").applyInArrow(_combined(longest, kind), ddl)
    phrases = scratch.save(dealt.groupBy("part").applyInArrow(_mine(longest, least, kind), "ids array<long>, a long"))
    scratch.drop(slabs)
    return phrases, words, totals


def scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """ids, a, l, r, score of each phrase at its lowest-scoring cut, ties to the shortest first part."""
    known = phrases.select("ids", "a").unionByName(words.select(F.array("number").alias("ids"), F.col("f").alias("a")))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids")))
    both = cuts.join(known.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first").join(known.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
    whole = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    score = F.expr(f"({whole('a')} * {whole('a')} * CAST({SCORED} AS DECIMAL(7, 0))) div ({whole('l')} * {whole('r')})")
    return both.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("ids", "a", "c.l", "c.r", "c.score")


def contained(phrases: DataFrame) -> DataFrame:
    """ids of the phrases that lie in a longer one with at least half as many occurrences."""
    n = F.size("ids")
    parts = phrases.filter(n > 2).select("a", "ids", F.explode(F.sequence(F.lit(2), n - 1)).alias("m"))
    parts = parts.select("a", "ids", "m", F.explode(F.sequence(F.lit(1), n - F.col("m") + 1)).alias("at")).groupBy(F.slice("ids", F.col("at"), F.col("m")).alias("ids")).agg(F.max("a").alias("longer"))
    return phrases.join(parts, "ids").filter(100 * F.col("longer") >= 50 * F.col("a")).select("ids")


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """found (ids, ...) with lang and phrase, the words joined by spaces."""
    each = found.select("*", F.posexplode("ids").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    rest = [c for c in found.columns if c != "ids"]
    back = each.groupBy("ids", *rest).agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("ws"))
    return back.select("lang", F.array_join(F.col("ws.word"), " ").alias("phrase"), *rest)


def best_of_each(found: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """The first ``most`` rows of each lang by score, a (descending) and phrase, with their rank from 1.

    All rows are sorted by ranges and saved; a row's rank is its place in its partition plus the lang's rows in earlier partitions.
    """
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    line = scratch.save(found.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("row")))
    starts = line.groupBy("lang", "p").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("start"))
    starts = starts.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("lang").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = line.join(starts.filter(F.col("before") < most).select("lang", "p", "start", "before"), ["lang", "p"])
    return ranked.withColumn("rank", F.col("before") + F.col("row") - F.col("start") + 1).filter(F.col("rank") <= most).drop("p", "row", "start", "before")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` collocations of two to ``longest`` words of each language."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    scratch = Scratch(docs.sparkSession)
    phrases, words, totals = phrase_counts(docs, scratch, longest, least, text_col, lang_col)
    kept = scores(phrases, words).join(contained(phrases), "ids", "left_anti")
    ranked = best_of_each(spelled(kept, words), scratch, most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP12_SQL = r"""
WITH p AS (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, row_number() OVER () AS pid, piece FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
u AS (SELECT lang, pid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM p),
t AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS m, x AS phrase FROM t UNION ALL SELECT lang, 2, x || ' ' || y FROM t WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM t WHERE z IS NOT NULL),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT c.*, k FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < m),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ((1000000::HUGEINT * k.a * k.a) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE m = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN d ON d.lang = b.lang AND d.part = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
