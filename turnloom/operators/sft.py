"""Masked training samples: dialogue flip, length filters, batches, packs, padding, learning-rate schedule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators.prompts import CHAT, ENDCONV, render_turn
from turnloom.ranking import running_before

IGNORED = -100
MAX_TOKENS = 4096
ID_RANGE = 1_000_000


def eligible(conv: Column, intent: Column) -> Column:
    """Non-blank intent, strictly alternating non-blank turns from a user turn, last turn the assistant's."""
    ok = C.rejection_reason(conv).isNull() & (F.size(conv) % 2 == 0)
    return F.coalesce(ok & ~T.is_blank(intent), F.lit(False))


def flip_segments(conv: Column, intent: Column, family: str) -> Column:
    """ARRAY<STRUCT<text, target>> whose texts joined are the sample; only user text and its end of turn are targets.

    System intent and assistant turns are context and carry the header of the next user turn; the conversation
    ends with a user turn holding the end token.
    """
    bos, _, end, header = CHAT[family]

    def context(role: Column, content: Column) -> Column:
        return F.struct(F.concat(render_turn(role, T.strip(content), family), F.lit(header)).alias("text"), F.lit(False).alias("target"))

    turns = F.transform(
        conv,
        lambda t: F.when(t["role"] == "user", F.struct(F.concat(T.strip(t["content"]), F.lit(end)).alias("text"), F.lit(True).alias("target"))).otherwise(
            context(t["role"], t["content"])))
    first = F.struct(F.concat(F.lit(bos), render_turn(F.lit("system"), T.strip(intent), family), F.lit(header)).alias("text"), F.lit(False).alias("target"))
    last = F.struct(F.lit(ENDCONV + end).alias("text"), F.lit(True).alias("target"))
    return F.concat(F.array(first), turns, F.array(last))


def word_ids(text: Column) -> Column:
    """Whitespace stand-in for a tokenizer: one stable id per word."""
    return F.transform(T.words(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(50000)).cast("int"))


def flip(df: DataFrame, family: str = "llama", tokenize: Callable[[Column], Column] = word_ids, final_token: int = 0) -> DataFrame:
    """Add input_ids and labels (IGNORED where no target) to (conversation, intent) rows; ineligible rows are dropped.

    ``tokenize`` maps a text column to ARRAY<INT>; the segment ends are token boundaries, so labels line up.
    """
    rows = df.where(eligible(F.col("conversation"), F.col("intent")))
    parts = F.transform(flip_segments(F.col("conversation"), F.col("intent"), family), lambda s: F.struct(tokenize(s["text"]).alias("ids"), s["target"].alias("target")))
    rows = rows.withColumn("__p", parts)
    ids = F.flatten(F.transform("__p", lambda p: p["ids"]))
    labels = F.flatten(F.transform("__p", lambda p: F.when(p["target"], p["ids"]).otherwise(F.transform(p["ids"], lambda _: F.lit(IGNORED)))))
    return rows.withColumn("input_ids", F.concat(ids, F.array(F.lit(final_token)))).withColumn("labels", F.concat(labels, F.array(F.lit(IGNORED)))).drop("__p")


def within_limit(df: DataFrame, ids: str = "input_ids", limit: int = MAX_TOKENS) -> DataFrame:
    return df.where(F.size(ids) <= limit)


def has_target(labels: Column) -> Column:
    """Any label but IGNORED from position 1 on."""
    return F.coalesce(F.exists(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x: x != IGNORED), F.lit(False))


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def pad(values: Column, width: int, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(F.lit(width) - F.size(values), F.lit(0))))


def padded_sample(ids: Column, labels: Column, width: int = MAX_TOKENS) -> Column:
    """STRUCT<input_ids, attention_mask, labels> padded to ``width`` (0, 0 and IGNORED); a longer sample is a runtime error."""
    made = F.struct(pad(ids, width, 0).alias("input_ids"), pad(attention_mask(ids), width, 0).alias("attention_mask"), pad(labels, width, IGNORED).alias("labels"))
    return F.when(F.size(ids) > width, F.raise_error(F.lit("sample longer than the bucket")).cast("struct<input_ids:array<int>,attention_mask:array<int>,labels:array<int>>")).otherwise(made)


def truncate_with_eos(ids: Column, max_len: int, eos: int) -> Column:
    return F.concat(F.slice(ids, 1, max_len - 1), F.array(F.lit(eos)))


def length_buckets(df: DataFrame, length: str, row_id: str, batch_size: int, world: int = 1, drop_last: bool = True) -> DataFrame:
    """Add batch (by length, then id; ``batch_size`` rows each) and worker = batch mod world.

    With ``drop_last`` the rows of an incomplete last batch, and of batches beyond a multiple of ``world``, go.
    ``row_id`` is an integer; a length shared by very many rows is ranked in ranges of ID_RANGE ids. Totals are summed
    over the ranges of each length, then over the lengths, so one task never gets more rows than there are lengths.
    """
    ranges = F.floor(F.col(row_id) / ID_RANGE)
    run = running_before(df, [], ranges, [row_id], F.lit(1), "__r", coarse=F.col(length))
    out = run.withColumn("batch", F.floor(F.col("__r") / batch_size)).withColumn("worker", F.pmod("batch", F.lit(world)).cast("int")).drop("__r")
    if not drop_last:
        return out
    whole = df.count() // batch_size // world * world
    return out.where(F.col("batch") < whole)


def _by_part(df: DataFrame, part: Column, order: list[str]) -> DataFrame:
    """Rows with their ``part``, each part whole in one task and in order; a task may get several parts."""
    return df.withColumn("part", part.cast("bigint")).repartition("part").sortWithinPartitions("part", *order)


def token_batches(df: DataFrame, length: str, row_id: str, budget: int, most: int) -> DataFrame:
    """Add part and batch: length-sorted batches with count * longest <= budget and at most ``most`` rows.

    A part holds the rows of as many binary digits of length and of one range of ID_RANGE ids, so it is the same in
    every run and never more than ID_RANGE rows; batches are cut within parts. A row longer than the budget is a batch
    of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, count = None, 0, 0
        for rb in batches:
            ids = []
            for n, part in zip(rb.column(length).to_pylist(), rb.column("part").to_pylist()):
                if part != last:
                    last, batch, count = part, 0, 0
                if count and (count >= most or (count + 1) * n > budget):
                    batch, count = batch + 1, 0
                count += 1
                ids.append(batch)
            yield rb.append_column("batch", pa.array(ids, pa.int64()))

    digits = F.char_length(F.bin(F.col(length)))
    parted = _by_part(df, digits * 1_000_000 + F.floor(F.col(row_id) / ID_RANGE), [length, row_id])
    return parted.mapInArrow(run, StructType([*parted.schema.fields, StructField("batch", LongType())]))


def packs(df: DataFrame, length: str, row_id: str, chunk: int, emit_tail: bool = False) -> DataFrame:
    """Add part and pack: samples in id order share a pack while its tokens stay below ``chunk``; none is split.

    A part is a range of ID_RANGE ids. As in the reference, the last pack of a part is dropped unless ``emit_tail``, a
    first sample of ``chunk`` or more tokens opens after an empty pack (number skipped), and a pack and sample of
    2*chunk or more are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pack, held, buffer = None, 0, 0, []
        schema = None
        for rb in batches:
            schema = rb.schema
            for i, (n, part) in enumerate(zip(rb.column(length).to_pylist(), rb.column("part").to_pylist())):
                if part != last:
                    if emit_tail and buffer:
                        yield _packed(buffer, schema, pack)
                    last, pack, held, buffer = part, 0, 0, []
                if held + n >= chunk:
                    if held + n >= 2 * chunk:
                        raise ValueError("sample too large")
                    if buffer:
                        yield _packed(buffer, schema, pack)
                    pack, held, buffer = pack + 1, 0, []
                held += n
                buffer.append(rb.slice(i, 1))
        if emit_tail and buffer:
            yield _packed(buffer, schema, pack)

    parted = _by_part(df, F.floor(F.col(row_id) / ID_RANGE), [row_id])
    return parted.mapInArrow(run, StructType([*parted.schema.fields, StructField("pack", LongType())]))


def _packed(rows: list[pa.RecordBatch], schema: pa.Schema, pack: int) -> pa.RecordBatch:
    one = pa.Table.from_batches(rows, schema).combine_chunks().to_batches()[0]
    return one.append_column("pack", pa.array([pack] * one.num_rows, pa.int64()))


def lr_schedule(step: Column, base: float, warmup: int, total: int, least: float = 0.0) -> Column:
    """Linear warm-up, cosine decay to ``least``, then flat."""
    progress = (step - warmup) / F.lit(float(max(1, total - warmup)))
    cosine = F.lit(least) + F.lit(base - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress))
    return F.when(step < warmup, F.lit(base) * (step + 1) / F.lit(float(max(1, warmup)))).when(step < total, cosine).otherwise(F.lit(least))
