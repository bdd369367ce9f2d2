"""Problem 3: lines repeated across one source's documents.

Pass 1 builds, in every partition, mergeable heavy-hitter summaries (Misra-Gries) of 64-bit line keys per
source. Adding up the counters and the error bounds of the partitions gives, for every line, an upper bound of
its count; lines whose bound reaches the threshold are candidates. Where a source's error bound itself reaches the
threshold, a line that no summary holds may be repeated too, so that source's lines are counted exactly instead.
Pass 2 counts the candidates exactly, by a 128-bit key. Confirmed lines are removed by per-source sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

#: Counters per source in one partition's summary. The error of a summary is at most lines/CAPACITY.
CAPACITY = 8192
#: Counters that one partition holds for all sources together, before it gives its summaries out and starts anew.
HELD = 200_000
#: Candidate or confirmed lists up to this many rows (16 to 64 bytes each) are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 500_000
#: Parts of a source's set of lines, by hash.
SLOTS = 1024
MIN_LETTERS, MIN_ROWS, MIN_SHARE = 20, 5, 0.02


def line_letters(line: Column) -> Column:
    """The letters of a line (any script), lower-cased; NULL for fewer than MIN_LETTERS letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(F.char_length(letters) >= MIN_LETTERS, letters)


def _turn_lines(conv: Column) -> Column:
    return F.flatten(F.transform(conv, lambda t: F.split(F.coalesce(t["content"], F.lit("")), "\n")))


def _prune(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries: keep at most ``capacity`` counters, taking the next largest count off all of them."""
    if len(counts) <= capacity:
        return keys, counts, 0
    off = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    keep = counts > off
    return keys[keep], counts[keep] - off, off


class _Summary:
    def __init__(self) -> None:
        self.keys, self.counts, self.error = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        every = np.concatenate([self.keys, keys])
        uniq, inv = np.unique(every, return_inverse=True)
        total = np.bincount(inv, np.concatenate([self.counts, counts]), len(uniq)).astype(np.int64)
        self.keys, self.counts, off = _prune(uniq, total, capacity)
        self.error += off


def _summaries(capacity: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, _Summary] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, s in by.items():
                n = len(s.keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (n + 1), pa.string()),
                        pa.array([None, *s.keys.tolist()], pa.int64()),
                        pa.array([0, *s.counts.tolist()], pa.int64()),
                        pa.array([s.error] + [0] * n, pa.int64()),
                    ],
                    ["source", "line", "n", "error"],
                )
            by.clear()

        for batch in batches:
            lines = batch.column("lines")
            names = batch.column("source").dictionary_encode()
            code = np.repeat(names.indices.to_numpy(zero_copy_only=False), np.diff(lines.offsets.to_numpy()))
            flat = lines.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((flat, code))
            code, flat = code[order], flat[order]
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, np.int64)
            counts = np.diff(np.append(new, len(flat)))
            ends = np.searchsorted(code[new], np.arange(len(names.dictionary) + 1))
            for i, name in enumerate(names.dictionary.to_pylist()):
                part = slice(ends[i], ends[i + 1])
                by.setdefault(name, _Summary()).add(flat[new[part]], counts[part], capacity)
            if sum(len(s.keys) + 1 for s in by.values()) > held:
                yield from out()
        yield from out()

    return run


def _rows(df: DataFrame, source: str, row_id: str, conv: str) -> DataFrame:
    return df.where(F.col(source).isNotNull()).select(F.col(row_id).alias("id"), F.col(source).alias("source"), F.col(conv).alias("conv"))


def confirmed_lines(stage: Stage, df: DataFrame, source: str = "model", row_id: str = "rec_id", conv: str = "conversation"):
    """(occurrences, confirmed): occurrences(source, key, id, turn, line_no) of candidates, confirmed(source, key, n).

    A line is repeated in a source if it occurs in at least MIN_ROWS rows and MIN_SHARE of the source's rows.
    Rows with a NULL source belong to none. ``row_id`` must be unique.
    """
    rows = _rows(df, source, row_id, conv)
    letters = F.filter(F.transform(_turn_lines(F.col("conv")), line_letters), lambda x: x.isNotNull())
    hashes = F.array_distinct(F.transform(letters, lambda x: F.xxhash64(x)))
    hashed = rows.select("source", F.coalesce(hashes, F.array().cast("array<bigint>")).alias("lines"))
    parts = hashed.mapInArrow(_summaries(CAPACITY, HELD), "source string, line bigint, n bigint, error bigint")
    merged = stage.write(parts.groupBy("source", "line").agg(F.sum("n").alias("n"), F.sum("error").alias("error")), "summaries")
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"))
    sizes = stage.write(sizes.withColumn("least", F.greatest(F.lit(MIN_ROWS), F.ceil(F.col("rows") * F.lit(MIN_SHARE) - 1e-9))), "sizes")
    bounds = sizes.join(merged.where(F.col("line").isNull()).select("source", "error"), "source")
    bounds = stage.write(bounds, "bounds")
    held = merged.where(F.col("line").isNotNull()).drop("error").join(bounds.where(F.col("error") < F.col("least")), "source")
    chosen = held.where(F.col("n") + F.col("error") >= F.col("least")).select("source", F.col("line").alias("h"))
    loose = bounds.where(F.col("error") >= F.col("least")).select("source", "least")
    if not loose.isEmpty():
        each = hashed.join(sized(loose), "source").select("source", "least", F.explode("lines").alias("h"))
        counted = each.groupBy("source", "least", "h").agg(F.count("*").alias("n"))
        chosen = chosen.unionByName(counted.where(F.col("n") >= F.col("least")).select("source", "h"))
    candidates = stage.write(chosen, "candidates")
    lines = (
        rows.select("id", "source", F.posexplode("conv").alias("turn", "t"))
        .select("id", "source", "turn", F.posexplode(F.split(F.coalesce("t.content", F.lit("")), "\n")).alias("line_no", "line"))
        .withColumn("letters", line_letters(F.col("line")))
        .where(F.col("letters").isNotNull())
        .select("id", "source", "turn", "line_no", F.xxhash64("letters").alias("h"), F.unhex(F.md5("letters")).alias("key"))
    )
    occurrences = stage.write(lines.join(sized(candidates), ["source", "h"]).drop("h"), "occurrences")
    exact = occurrences.select("source", "key", "id").distinct().groupBy("source", "key").agg(F.count("*").alias("n"))
    confirmed = exact.join(sizes, "source").where(F.col("n") >= F.col("least")).select("source", "key", "n")
    return occurrences, stage.write(confirmed, "confirmed")


def sized(small: DataFrame) -> DataFrame:
    """A broadcast hint where the written list is within BROADCAST_ROWS, else the plain table (a shuffled join)."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def repeated_lines(df: DataFrame) -> DataFrame:
    """(rec_id, turn, line_no) of every occurrence of a repeated line; empty input gives an empty result."""
    stage = Stage(df.sparkSession, "repeated-lines")
    occurrences, confirmed = confirmed_lines(stage, df)
    return occurrences.join(sized(confirmed.select("source", "key")), ["source", "key"], "left_semi").select(
        F.col("id").alias("rec_id"), F.col("turn").cast("int").alias("turn"), F.col("line_no").cast("int").alias("line_no")
    )


def _cut(conv: Column, goes: Callable[[Column, Column, Column], Column]) -> Column:
    """``conv`` without the lines for which ``goes(line, turn, line number)`` is true; NULL contents stay."""

    def turn(t: Column, i: Column) -> Column:
        keep = F.filter(F.split(t["content"], "\n"), lambda x, j: ~F.coalesce(goes(x, i, j), F.lit(False)))
        return F.struct(t["role"].alias("role"), F.array_join(keep, "\n").alias("content"))

    return F.transform(conv, turn)


def remove_repeated_lines(df: DataFrame, source: str = "model", row_id: str = "rec_id", conv: str = "conversation", bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the repeated lines cut from every turn of ``conv``; all other lines and columns are kept.

    Rows with a NULL source, NULL conversations and NULL contents come out unchanged; a turn whose lines are
    all repeated keeps an empty content. Up to ``bound`` confirmed lines are broadcast as per-source sets in SLOTS
    slots by hash, so a line is looked up among few others and no row is moved. Beyond it, the places of the confirmed lines
    are joined to their rows by ``row_id`` (unique, so no key is hot); hot lines are salted.
    """
    stage = Stage(df.sparkSession, "repeated-lines")
    occurrences, confirmed = confirmed_lines(stage, df, source, row_id, conv)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if confirmed.count() <= bound:
        slot = lambda key: F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
        slots = confirmed.groupBy("source", slot(F.col("key")).alias("slot")).agg(F.collect_set("key").alias("keys"))
        by = slots.groupBy(F.col("source").alias("__source")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "keys"))).alias("m"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.try_element_at("m", i))
        sets = F.broadcast(by.select("__source", filled.alias("__cut")))

        def repeated(line: Column, turn: Column, number: Column) -> Column:
            return T.let(F.unhex(F.md5(line_letters(line))), lambda key: F.array_contains(F.get(F.col("__cut"), slot(key)), key))

        out = df.join(sets, F.col(source) == F.col("__source"), "left")
        cleaned = F.when(F.col("__cut").isNull(), F.col(conv)).otherwise(_cut(F.col(conv), repeated))
    else:
        hits = join_counted(occurrences, confirmed, ["source", "key"], "n", F.col("id"), hot_threshold(confirmed, "n"))
        places = hits.groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct(F.col("turn").cast("int").alias("t"), F.col("line_no").cast("int").alias("l"))).alias("__at"))
        out = df.join(places, F.col(row_id) == F.col("__id"), "left")
        placed = lambda line, turn, number: F.array_contains(F.col("__at"), F.struct(turn.alias("t"), number.alias("l")))
        cleaned = F.when(F.col("__at").isNull(), F.col(conv)).otherwise(_cut(F.col(conv), placed))
    return out.withColumn(conv, cleaned).select(*columns)
