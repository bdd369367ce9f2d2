"""Problem 8: fill fixed-capacity containers with items.

Sizes are tokens of a public tokenizer. Large-item matching: an item above half the capacity shares a container
with at most one other item above a third; items between a third and a half pair with each other. The matching
is greedy by complementary size, and the smaller items then fill the gaps best-fit. Only items larger than the
capacity are split. At scale the packing works on the counts of each size, not on the documents: there are at
most ``capacity`` sizes, whatever the number of documents. Container numbers and documents are then matched by
rank, so the whole step is two aggregations and equi-joins.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.staging import Stage

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Items ranked by one task.
RANKS_PER_TASK = 1_000_000


def load_encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str | None = None):
    """A tiktoken encoder from a rank file in ``folder``; nothing is trained or copied.

    Without a ``pattern`` for splitting texts, the one of the folder's own module is taken.
    """
    import importlib.util

    import tiktoken

    if pattern is None:
        spec = importlib.util.spec_from_file_location("tokenizer_folder", f"{folder}/__init__.py")
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        pattern = module.PATTERN
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counting(folder: str, vocabulary: str, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(folder, vocabulary, pattern)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(doc_id, tokens) over whole texts; NULL and empty texts have 0 tokens."""
    return docs.select("doc_id", "text").mapInArrow(_counting(folder, vocabulary, pattern), "doc_id bigint, tokens bigint")


class _Sizes:
    """A multiset of sizes with best-fit look-up; as many entries as there are distinct sizes."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def best(self, room: int) -> int | None:
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect_right(self.order, size) - 1)

    def largest(self) -> int | None:
        return self.order[-1] if self.order else None


def pack_sizes(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes of one container, number of such containers) for ``counts`` of sizes between 1 and ``capacity``.

    Items above a third of the capacity are matched first: each above half with its best-fitting partner, the
    others in the best-fitting pairs. Then each kind of container, least room first, takes the largest smaller
    item that fits, over and over; what is left opens containers filled the same way. Equal containers are
    handled together, so the cost grows with distinct sizes and patterns, not with items.
    """
    third = capacity // 3
    large, small = _Sizes({s: n for s, n in counts.items() if s > third}), _Sizes({s: n for s, n in counts.items() if 0 < s <= third})
    open_: list[tuple[int, tuple[int, ...], int]] = []  # (room, sizes, number)
    while (top := large.largest()) is not None:
        n = large.count[top]
        large.take(top, n)
        while n:
            mate = large.best(capacity - top)
            if 2 * top <= capacity and n > 1 and (mate is None or mate < top):
                mate, k = top, n // 2  # pairs of this size itself
                open_.append((capacity - 2 * top, (top, top), k))
                n -= 2 * k
                continue
            if mate is None:
                open_.append((capacity - top, (top,), n))
                break
            k = min(n, large.count[mate])
            large.take(mate, k)
            open_.append((capacity - top - mate, (top, mate), k))
            n -= k
    done: list[tuple[tuple[int, ...], int]] = []
    open_.sort()

    def fill(room: int, sizes: tuple[int, ...], number: int) -> None:
        """Fill ``number`` equal containers best-fit; where items run out, the rest goes on with the next size."""
        stack = [(room, sizes, number)]
        while stack:
            room, sizes, number = stack.pop()
            size = small.best(room)
            if size is None:
                done.append((sizes, number))
                continue
            # equal containers take the size in turn: first one each, repeats follow when the loop comes back
            k = min(number, small.count[size])
            small.take(size, k)
            if number > k:
                stack.append((room, sizes, number - k))
            stack.append((room - size, (*sizes, size), k))

    for room, sizes, number in open_:
        fill(room, sizes, number)
    while (top := small.largest()) is not None:
        per = max(1, capacity // top)
        number = max(1, small.count[top] // per)
        fill(capacity, (), number)
    return done


def pack_documents(sized: DataFrame, capacity: int) -> DataFrame:
    """(container, slot, doc_id, part, first_token, tokens): every token of every document in one container.

    ``sized`` is (doc_id, tokens). A document above the capacity is split into full containers and a remainder,
    which is packed like a document; no other is split. Documents of 0 tokens take no room: part 0 of container
    NULL. Repeated doc_ids are packed as separate items. The driver gets the counts of the sizes, at most
    ``capacity`` rows.
    """
    spark = sized.sparkSession
    stage = Stage(spark, "packing")
    cap = F.lit(capacity).cast("bigint")
    last = F.greatest(F.ceil(F.col("tokens") / cap), F.lit(1)).cast("bigint") - 1
    parts = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    parts = parts.select("doc_id", F.col("part").cast("int").alias("part"), (F.col("part") * cap).alias("first_token"),
                         F.least(cap, F.col("tokens") - F.col("part") * cap).alias("tokens"))
    parts = stage.write(parts, "parts")
    counts = {r["tokens"]: r["n"] for r in parts.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    container = 1
    for sizes, number in pack_sizes(counts, capacity):
        per: dict[int, int] = defaultdict(int)
        for s in sizes:
            per[s] += 1
        for s, k in per.items():
            slots[s].append((s, rank[s], container, k, number, sizes.index(s)))
            rank[s] += k * number
        container += number
    # ranks of one size are cut into blocks of about one run each; a run is listed in every block it reaches
    blocks = {s: max(1, counts[s] // len(v)) for s, v in slots.items()}
    runs = spark.createDataFrame([(*x, blocks[x[0]]) for v in slots.values() for x in v],
                                 "tokens bigint, start bigint, container bigint, each bigint, number bigint, slot int, width bigint")
    ends = F.floor((F.col("start") + F.col("each") * F.col("number") - 1) / F.col("width"))
    runs = stage.write(runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), ends))).drop("width"), "runs")
    widths = spark.createDataFrame(list(blocks.items()), "tokens bigint, width bigint")
    buckets = max(64, sum(counts.values()) // RANKS_PER_TASK)
    ranked = parts.where("tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)))
    per_bucket = ranked.groupBy("tokens", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("tokens", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "part")) - 1
    ranked = ranked.withColumn("inside", inside).join(per_bucket, ["tokens", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    ranked = ranked.join(F.broadcast(widths), "tokens").withColumn("block", F.floor(F.col("rank") / F.col("width")))
    hit = ranked.join(runs, ["tokens", "block"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("each") * F.col("number")))
    place = F.col("rank") - F.col("start")
    placed = hit.select(
        (F.col("container") + F.floor(place / F.col("each"))).cast("bigint").alias("container"),
        (F.col("slot") + F.pmod(place, F.col("each"))).cast("int").alias("slot"),
        "doc_id", "part", "first_token", "tokens",
    )
    empty = parts.where("tokens = 0").select(F.lit(None).cast("bigint").alias("container"), F.lit(0).alias("slot"), "doc_id", "part", "first_token", "tokens")
    return placed.union(empty)


def pack_all(docs: DataFrame, spec: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """:func:`pack_documents` for every row of ``spec(container, capacity_tokens)``, with the kind's name in front.

    Texts are tokenized once. ``spec`` lists container kinds; it is read by the driver. Rows with a NULL or
    non-positive capacity are ignored.
    """
    stage = Stage(docs.sparkSession, "packing")
    sized = stage.write(token_counts(docs, folder, vocabulary, pattern), "sized")
    kinds = spec.where(F.col("capacity_tokens") > 0).select("container", "capacity_tokens").distinct().orderBy("container").collect()
    out = docs.sparkSession.createDataFrame([], "kind string, container bigint, slot int, doc_id bigint, part int, first_token bigint, tokens bigint")
    for r in kinds:
        packed = pack_documents(sized, r["capacity_tokens"])
        out = out.unionByName(packed.withColumn("kind", F.lit(r["container"])))
    return out
