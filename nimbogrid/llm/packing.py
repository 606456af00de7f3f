"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

A document is its token ids and one closing id. What is longer than the capacity is cut into pieces of exactly
the capacity, of which the first may be shorter; nothing else is cut. Then pieces go into sequences by
best fit: the pieces are sorted by length, longest first, and in each round all pieces of the next length go
to their successors among the open gaps: the smallest gaps that hold them, gap by gap in sorted order, the
piece of rank r in its length taking the r-th place on offer; gaps are updated, new sequences opened for what is
left over, and the next round follows.

Lengths are whole numbers up to the capacity. So the sorted order of the pieces is known from their counts by
length, at most ``capacity`` numbers for any amount of data, and a gap table is a few thousand runs of equal gaps.
The rounds run over these runs. All that is per piece stays distributed: a piece's rank in its length is its rank
in its batch plus the counts of earlier batches, and its place is found from (length, rank) by binary search.

This is best fit, longest first, to the sequence. Its rounds are not run as Spark jobs over the pieces: pieces of one
length are alike, so the sweep over ranges, the ranks that settle conflicts and the gaps' updates need no more than the counts, and the
driver holds at most ``capacity`` of them.

Texts are tokenised once. A text is split at single spaces between other characters, where the pre-tokeniser always
splits too, and each distinct word is encoded by the tokeniser itself once and remembered; whole texts are covered
whatever they hold, and the ids are those of the whole text (tests compare them). A text that holds the string of an added token,
such as a special one, is given to the tokeniser whole.

Defined results: null and empty texts are one closing id, one piece of length 1. Repeated rows are packed each. An
empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CAPACITY, CLOSING = 2048, 0
#: Words that a worker remembers, before it starts anew.
REMEMBER = 500_000
#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_APART = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r" \s|\s ")
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f]")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 as it is, other bytes from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """word -> ids of " " + word as bytes; a word is encoded when it is first asked for."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are tokens of their own wherever they stand; a text with one is encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._same_merges(path)

    def _same_merges(self, path: str):
        """An encoder with the file's own vocabulary that is quicker on single words, where it must give the same ids.

        That is so where merges are ranked as their results are numbered, after the 256 bytes. Its ids are compared
        with the tokeniser's on this vocabulary's own tokens too; otherwise there is none.
        """
        import tiktoken

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model["vocab"]
        if model.get("type") != "BPE" or model.get("ignore_merges") or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        byte, special = _byte_of(), {self.tokenizer.id_to_token(i) for i in self.tokenizer.get_added_tokens_decoder()}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        some = [b.decode("utf-8", "replace") for b in list(ranks)[:: max(1, len(ranks) // 2000)]]
        some = [a + b for a, b in zip(some, some[::-1], strict=True)]
        return own if [own(x) for x in some] == [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)] else None

    def encode(self, text: str) -> bytes:
        if self.quick:
            return array("I", self.quick(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(" " + word)
        return ids


#: Kept from task to task by a worker process.
_MEMORIES: dict[str, Memory] = {}


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit numbers, by a byte-level BPE tokeniser and a memory of words."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        if path not in _MEMORIES:
            _MEMORIES[path] = Memory(path)
        self.memory = _MEMORIES[path]

    def __call__(self, text: str) -> bytes:
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        if any(t in text for t in self.memory.added):
            return array("I", self.memory.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        odd = "  " in text or " \n" in text or "\n " in text or (not text.isascii() or _RARE.search(text)) and _ODD.search(text)
        first, *rest = _APART.split(text) if odd else text.split(" ")
        return self.memory.encode(first) + b"".join(map(self.memory.__getitem__, rest))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(path: str | None, capacity: int, closing: int, keep_ids: bool, slab: int = 4 << 20):
    end = np.array([closing], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, task, n = WordTokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            group = np.cumsum(lengths) // slab  # tokenised a few MB at a time
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, k, start, length, zlib.crc32(part), part if keep_ids else None))
                length = np.array([r[3] for r in rows])
                order = np.argsort(length, kind="stable")
                run_start = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
                rank = np.empty(len(rows), np.int64)
                rank[order] = np.arange(len(rows)) - np.repeat(run_start, np.diff(np.r_[run_start, len(rows)]))
                doc, k, start, _, crc, ids = zip(*rows, strict=True)
                # The batch's number is the same when a lost task runs again: it reads the same rows in the same order.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task << 32 | n] * len(rows), pa.int64()), pa.array(rank), *([pa.array(ids, pa.binary())] if keep_ids else [])],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "batch", "rank", *(["ids"] if keep_ids else [])],
                )
                n += 1

    return run


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places for counts[n] pieces of each length n: (length, first rank, first sequence, offset), sorted.

    The place of the piece of rank r in its length is that of the last entry with first rank <= r, r - first rank
    sequences further on. One round for each length, longest first, over runs of equal gaps: the sequences of a run are filled one after
    the other, as best fit fills them.
    """
    from bisect import bisect_left, insort

    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted
    places, opened = [], 0
    for n in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[n], 0
        at = bisect_left(gaps, (n,))
        changed = []
        while left:
            if at < len(gaps):  # the successor: the smallest gap that holds it
                gap, first, m = gaps.pop(at)
            else:
                gap, first, m = capacity, opened, left
            # Equal pieces go on into one sequence while they fit: what is left of its gap is the smallest one that holds them.
            each = gap // n
            used = min(m, -(-left // each))
            full, rest = divmod(min(left, used * each), each)
            for k in range(each):
                own = full + (k < rest)
                if own:
                    places.append((n, rank, first, capacity - gap + k * n))
                    rank += own
            left -= full * each + rest
            if gap == capacity and first == opened:
                opened += used
                m = used
            for g in ((gap - each * n, first, full), (gap - rest * n, first + full, int(rest > 0)), (gap, first + used, m - used)):
                if g[0] and g[2]:
                    changed.append(g)
        for g in changed:
            insort(gaps, g)
    table = np.array(sorted(places), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _place(plan):
    length, rank0, first, offset = plan
    keys = length << 44 | rank0

    def run(batches):
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("place").to_numpy()
            at = np.searchsorted(keys, n << 44 | r, side="right") - 1
            keep = [c for c in b.schema.names if c != "place"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(first[at] + r - rank0[at]), pa.array(offset[at])], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids its ids (uint32, binary)."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = ", ids binary" if keep_ids else ""
    pieces = scratch.save(plain.mapInArrow(_pieces(tokenizer_path, capacity, closing, keep_ids), f"doc_id long, piece int, start long, length long, ids_crc32 long, batch long, rank long{ids}"))
    counts = scratch.save(pieces.groupBy("batch", "length").agg(F.count(F.lit(1)).alias("n")))
    plan = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most capacity rows
    before = Window.partitionBy("length").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("batch", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["batch", "length"]).withColumn("place", F.col("base") + F.col("rank"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return ranked.select(*cols, "place").mapInArrow(_place(plan), f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")


def op10(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
