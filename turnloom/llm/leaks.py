"""Problem 9: evaluation passages inside training text, by suffix arrays over shards of the training words.

Every partition builds suffix arrays over shards of its documents' words (sorted by the first MIN_WORDS words,
the least match that counts), binary-searches every suffix of the evaluation texts in them and extends the hits
to their longest verbatim match. A document lies in one shard, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words of one shard's suffix array (a longer document makes a longer shard).
SHARD_WORDS = 1_000_000
#: Evaluation words per block: a larger evaluation set is searched block by block, each with its own pass.
BLOCK_WORDS = 2_000_000

MATCHES = "doc_id bigint, task_id string, words int, doc_word int, task_word int"


def word_array(text: Column) -> Column:
    """Maximal runs of letters or digits of any script, lower-cased."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


class Tests:
    """The evaluation words as vocabulary ids, texts one after another with a break (id 0) behind each."""

    def __init__(self, tasks: list[tuple[str, list[str]]]):
        kept = [(t, w) for t, w in tasks if len(w) >= MIN_WORDS]
        self.vocabulary = pa.array(sorted({w for _, ws in kept for w in ws}), pa.string())
        ids, owner, place = [], [], []
        for i, (_, ws) in enumerate(kept):
            code = pc.index_in(pa.array(ws, pa.string()), self.vocabulary).to_numpy(zero_copy_only=False) + 1
            ids += [code, [0]]
            owner.append(np.full(len(ws) + 1, i))
            place.append(np.arange(len(ws) + 1))
        self.names = [t for t, _ in kept]
        self.ids = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)


def _starts(ids: np.ndarray) -> np.ndarray:
    """Positions followed by MIN_WORDS ids without a break: the only suffixes that can match."""
    if len(ids) < MIN_WORDS:
        return np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(bad[MIN_WORDS:] == bad[:-MIN_WORDS])


def _packed(ids: np.ndarray, at: np.ndarray, bits: int) -> list[np.ndarray]:
    """The first MIN_WORDS ids of each suffix, packed into as few 63-bit keys as possible."""
    per, keys = max(1, 63 // bits), []
    for base in range(0, MIN_WORDS, per):
        key = np.zeros(len(at), np.int64)
        for k in range(base, min(base + per, MIN_WORDS)):
            key = (key << bits) | ids[at + k]
        keys.append(key)
    return keys


def search_shard(ids: np.ndarray, tests: Tests) -> Iterator[tuple[int, int, int]]:
    """(word position, test position, matched words), the longest match of each (position, test text) start.

    Suffix array: the shard's possible suffixes in the order of their first MIN_WORDS words. Each test suffix
    finds its interval by binary search, one packed key after another. A match is given once, at its first word.
    """
    at, probe = _starts(ids), _starts(tests.ids)
    if not len(at) or not len(probe):
        return
    bits = int(len(tests.vocabulary)).bit_length()
    keys, wanted = _packed(ids, at, bits), _packed(tests.ids, probe, bits)
    order = np.lexsort(keys[::-1])
    low, high = np.zeros(len(probe), np.int64), np.full(len(probe), len(at), np.int64)
    for key, want in zip(keys, wanted):
        column = key[order]
        if key is keys[0]:
            low, high = np.searchsorted(column, want, "left"), np.searchsorted(column, want, "right")
            continue
        for i in np.flatnonzero(low < high):
            part = column[low[i] : high[i]]
            low[i], high[i] = low[i] + np.searchsorted(part, want[i], "left"), low[i] + np.searchsorted(part, want[i], "right")
    width = high - low
    q = np.repeat(probe, width)
    within = np.arange(len(q)) - np.repeat(np.cumsum(width) - width, width)
    p = at[order[np.repeat(low, width) + within]]
    # a hit whose words before it match too lies inside a match that began earlier
    before = np.where((p > 0) & (q > 0), ids[p - 1], 0)
    starts = (before == 0) | (before != tests.ids[q - 1])
    p, q = p[starts], q[starts]
    words = np.full(len(p), MIN_WORDS)
    open_ = np.arange(len(p))
    padded, asked = np.append(ids, 0), np.append(tests.ids, 0)
    while len(open_):
        a, b = padded[p[open_] + words[open_]], asked[q[open_] + words[open_]]
        open_ = open_[(a != 0) & (a == b)]
        words[open_] += 1
    yield from zip(p.tolist(), q.tolist(), words.tolist())


def _searcher(tasks: list[tuple[str, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = Tests(tasks)
        docs: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, doc = np.concatenate(parts), np.concatenate(docs)
            first = np.concatenate([[0], np.cumsum(np.concatenate(owners))])
            rows = []
            for p, q, n in search_shard(ids, tests):
                d = int(np.searchsorted(first, p, "right")) - 1
                rows.append((int(doc[d]), tests.names[tests.owner[q]], n, p - int(first[d]), int(tests.place[q])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                    ["doc_id", "task_id", "words", "doc_word", "task_word"],
                )

        for batch in batches:
            words = batch.column("words")
            code = pc.index_in(words.flatten(), tests.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False) + 1
            ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
            parts.append(np.insert(code.astype(np.int64), ends, 0))  # a break behind each document
            owners.append(np.diff(words.offsets.to_numpy()) + 1)
            docs.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
            held += len(code)
            if held >= SHARD_WORDS:
                yield from out()
                docs, parts, owners, held = [], [], [], 0
        if held:
            yield from out()

    return run


def matches(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(doc_id, task_id, words, doc_word, task_word): every longest verbatim match of MIN_WORDS words or more.

    Texts that are NULL, empty or shorter than MIN_WORDS words match nothing. The evaluation texts are the
    stated query set: their size is measured and they are searched in blocks of BLOCK_WORDS words, each block
    small enough for every worker.
    """
    slim = docs.select("doc_id", word_array(F.col("text")).alias("words")).where(F.size("words") >= MIN_WORDS)
    rows = tasks.select("task_id", word_array(F.col("problem")).alias("w")).where(F.size("w") >= MIN_WORDS).toLocalIterator()
    block, held, out = [], 0, None

    def searched() -> DataFrame:
        found = slim.mapInArrow(_searcher(block), MATCHES)
        return found if out is None else out.union(found)

    for r in rows:
        block.append((r["task_id"], list(r["w"])))
        held += len(r["w"])
        if held >= BLOCK_WORDS:
            out, block, held = searched(), [], 0
    return searched() if block or out is None else out


def leaked_pairs(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(doc_id, task_id): each document with each evaluation item it holds MIN_WORDS consecutive words of."""
    return matches(docs, tasks).select("doc_id", "task_id").distinct()


def remove_leaked(docs: DataFrame, tasks: DataFrame) -> DataFrame:
    """The documents without any leaked passage, all columns kept. Rows with a NULL doc_id stay."""
    return docs.join(matches(docs, tasks).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
