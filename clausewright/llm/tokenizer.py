"""Encoding of a corpus with a public byte-level BPE tokenizer by corpus-level merge replay.

The distinct pretokens of the whole corpus are found first; each is encoded once. A task takes a
hash partition of them, builds an inverted index from token pair to positions in all its words (or,
so that its memory is bounded, in parts of ``INDEX_CHARS`` characters), and replays the merge table
in rank order, touching only the positions of the pair at hand and their neighbours (a merge can
only create pairs of later rank, so one sweep is enough). No pair crosses a word, so how the words
are dealt to tasks changes no id. The encoded pretokens then go back to the documents: both sides
are grouped by a hash block of documents, so what is shuffled is each document once and each
pretoken once per block, not once per occurrence. A block holds about ``ROWS_PER_BLOCK`` documents
or ``CHARS_PER_BLOCK`` characters, whichever is less.

Defined results: one row per input row; null and empty texts give the empty list; strings that
look like special tokens are ordinary text; repeated rows and null ids are kept; an empty table
gives an empty result; extra columns are ignored. Whole texts are encoded whatever their length.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BLOCK = 4096
CHARS_PER_BLOCK = 16_000_000
INDEX_CHARS = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load_merges(path: str) -> tuple[dict[tuple[int, int], tuple[int, int]], list[int], str]:
    """{(left id, right id): (rank, merged id)}, the id of each byte, and the pretoken pattern."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # the printable alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the rest counts up from 256
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    sign = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
    merges = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return merges, [vocab[sign[b]] for b in range(256)], public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def pretokenizer(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def replay(words: list[str], merges: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int]) -> list[list[int]]:
    """Token ids of each word: all merges in rank order over all words at once."""
    ids: list[int] = []
    starts = []
    for w in words:
        starts.append(len(ids))
        ids.extend(byte_ids[b] for b in w.encode("utf-8"))
        ids.append(-1)  # no pair crosses a word's end
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    index: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(ids, ids[1:])):
        if pair in merges:
            index[pair].append(i)
    queue = [(merges[p][0], p) for p in index]
    heapq.heapify(queue)
    gone = bytearray(len(ids))
    while queue:
        _, pair = heapq.heappop(queue)
        left, right = pair
        merged = merges[pair][1]
        for i in sorted(index.pop(pair, ())):
            if gone[i] or ids[i] != left:
                continue
            j = after[i]
            if ids[j] != right:
                continue
            k, h = after[j], before[i]
            ids[i] = merged
            gone[j] = 1
            after[i] = k
            before[k] = i
            for at, new in ((i, (merged, ids[k])), (h, (ids[h], merged) if h >= 0 else None)):
                if new in merges:
                    if new not in index:
                        heapq.heappush(queue, (merges[new][0], new))
                    index[new].append(at)
    out = []
    for s in starts:
        word = []
        i = s
        while ids[i] != -1:
            word.append(ids[i])
            i = after[i]
        out.append(word)
    return out


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(documents: DataFrame, vocabulary: str | None = None, rows_per_block: int = ROWS_PER_BLOCK, chars_per_block: int = CHARS_PER_BLOCK, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, ids): the token ids of each document."""
    path = vocabulary or default_vocabulary()
    whole = documents.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-whole["rows"] // rows_per_block), -(-(whole["chars"] or 0) // chars_per_block))
    docs = documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pretokenizer(load_merges(path)[2]).findall
        for batch in batches:
            seen: dict[int, set[str]] = defaultdict(set)
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    seen[block].update(cut(text))
            rows = [(b, w) for b, ws in seen.items() for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["block", "word"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, byte_ids, _ = load_merges(path)
        words: list[str] = []
        held = 0

        def encoded() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), _lists(replay(words, merges, byte_ids))], names=["word", "word_ids"])

        for batch in batches:
            for word in batch.column(0).to_pylist():
                words.append(word)
                held += len(word)
                if held >= index_chars:
                    yield encoded()
                    words, held = [], 0
        yield encoded()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        cut = pretokenizer(load_merges(path)[2]).findall
        known = dict(zip(right.column("word").to_pylist(), right.column("word_ids").to_pylist()))
        rows = [[i for w in cut(text) for i in known[w]] if text else [] for text in left.column("text").to_pylist()]
        return pa.table([left.column("doc_id"), _lists(rows)], names=["doc_id", "ids"])

    used = docs.select("block", "text").mapInArrow(find, "block int, word string").distinct()
    table = used.select("word").distinct().mapInArrow(encode, "word string, word_ids array<int>")
    placed = used.join(table, "word").select("block", "word", "word_ids")
    return docs.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(assemble, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``documents`` with ``n_tokens``, the length of each text in tokens; 0 for null and empty texts."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([*documents.schema.fields, T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, byte_ids, pattern = load_merges(path)
        cut = pretokenizer(pattern).findall
        known: dict[str, int] = {}
        for batch in batches:
            split = [cut(t) if t else [] for t in batch.column(text_at).to_pylist()]
            fresh = list({w for ws in split for w in ws if w not in known})
            if len(known) > 500_000:
                known.clear()
                fresh = list({w for ws in split for w in ws})
            known.update((w, len(i)) for w, i in zip(fresh, replay(fresh, merges, byte_ids)))
            sizes = pa.array([sum(known[w] for w in ws) for ws in split], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes], names=[*batch.schema.names, "n_tokens"])

    text_at = documents.columns.index("text")
    return documents.mapInArrow(count, schema)
