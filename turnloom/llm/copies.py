"""Problem 6: duplicates hidden by formatting differences, as an incremental ledger.

The ledger is a kept table with one row per distinct record: its canonical key, the key's bucket, the number of
copies and the earliest representative. It is stored by bucket. A batch is aggregated by key, then
full-outer-joined with the matching buckets only; counts add up, the earlier representative stays, and only those
buckets are written anew.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

#: Buckets of a new ledger; a bucket is rewritten as a whole, so a ledger of billions of records wants thousands.
BUCKETS = 64
LEDGER = "key binary, bucket int, copies bigint, rep bigint"


def canonical_text(col: Column) -> Column:
    """Letters and digits of any script in order, lower-cased; everything else is dropped. NULL is ''."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{Nd}]+", "")


def canonical_json(col: Column) -> Column:
    """One spelling per JSON value: fields ordered, spacing gone. Text that is no JSON stands for itself."""
    return F.coalesce(F.to_json(F.try_parse_json(col)), F.concat(F.lit("raw:"), col), F.lit("null:"))


def record_key(source: Column, conv: Column, meta: Column) -> Column:
    """128-bit digest of source, roles and canonical contents in order, and canonical meta."""
    turns = F.transform(conv, lambda t: F.concat(F.coalesce(t["role"], F.lit("\x00")), F.lit("\x01"), canonical_text(t["content"])))
    body = F.coalesce(F.array_join(turns, "\x02"), F.lit("\x00"))
    parts = F.concat_ws("\x03", F.coalesce(source, F.lit("\x00")), F.coalesce(F.size(conv), F.lit(-1)).cast("string"), body, canonical_json(meta))
    return F.unhex(F.md5(parts))


def batch_counts(keyed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Aggregate a batch (key, rec_id) to ledger rows; copies combine map-side, so a hot record costs no skew."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    return keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("rec_id").alias("rep")).select("key", bucket.alias("bucket"), "copies", "rep")


def advance(ledger: DataFrame, counts: DataFrame) -> DataFrame:
    """The ledger after one aggregated batch: full outer join by (bucket, key), counts added, earliest kept."""
    old, new = ledger.alias("o"), counts.alias("n")
    joined = old.join(new, (F.col("o.bucket") == F.col("n.bucket")) & (F.col("o.key") == F.col("n.key")), "full_outer")
    return joined.select(
        F.coalesce("o.key", "n.key").alias("key"),
        F.coalesce("o.bucket", "n.bucket").alias("bucket"),
        (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).alias("copies"),
        F.least("o.rep", "n.rep").alias("rep"),
    )


class Ledger:
    """A ledger kept under ``path``: folders ``v<number>/bucket=<bucket>``, and numbered states that name them.

    A state is a small file with the folder of every bucket and the names of the batches folded in. It appears under
    its number by a rename after all its folders are complete, so a failed fold leaves the state before it, and a
    batch that is folded in again under its name changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._load(buckets)

    def _load(self, buckets: int) -> None:
        states = self._fs.globStatus(self._hadoop.Path(f"{self.path}/state-*.json"))
        self.state = {"number": 0, "buckets": buckets, "folders": {}, "batches": []}
        if states:
            last = max(str(s.getPath()) for s in states)
            stream = self._fs.open(self._hadoop.Path(last))
            try:
                self.state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

    def _save(self, state: dict) -> None:
        target = self._hadoop.Path(f"{self.path}/state-{state['number']:08d}.json")
        draft = self._hadoop.Path(f"{self.path}/draft-{state['number']:08d}.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, target):
            raise RuntimeError(f"another writer made {target}")
        self.state = state

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """(key, bucket, copies, rep) of some buckets, or of all; only their folders are read."""
        chosen = [(b, f) for b, f in self.state["folders"].items() if buckets is None or int(b) in set(buckets)]
        if not chosen:
            return self.spark.createDataFrame([], LEDGER)
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in chosen]
        rows = self.spark.read.schema("key binary, copies bigint, rep bigint").parquet(*paths)
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.state["buckets"])).cast("int")
        return rows.select("key", bucket.alias("bucket"), "copies", "rep")

    def fold(self, keyed: DataFrame, batch: str) -> int:
        """Fold one batch (key, rec_id) in; the number of buckets written. A known batch writes none."""
        if batch in self.state["batches"]:
            return 0
        stage = Stage(self.spark, "copies-batch")
        counts = stage.write(batch_counts(keyed, self.state["buckets"]), "counts")
        touched = sorted(r["bucket"] for r in counts.select("bucket").distinct().collect())  # at most the number of buckets
        number = self.state["number"] + 1
        if touched:
            after = advance(self.read(touched), counts).repartition("bucket")
            after.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{number}")
        folders = {**self.state["folders"], **{str(b): f"v{number}" for b in touched}}
        self._save({**self.state, "number": number, "folders": folders, "batches": [*self.state["batches"], batch]})
        stage.clear()
        return len(touched)


def _folded(df: DataFrame, batches: int, path: str | None, delivery: str) -> tuple[DataFrame, DataFrame]:
    stage = Stage(df.sparkSession, "copies")
    keyed = df.select("rec_id", record_key(F.col("source"), F.col("conversation"), F.col("meta")).alias("key"))
    keyed = stage.write(keyed, "keys")
    ledger = Ledger(df.sparkSession, path or f"{stage.root}/ledger")
    for b in range(batches):
        one = keyed.where(F.pmod(F.xxhash64("rec_id"), F.lit(batches)) == b) if batches > 1 else keyed
        ledger.fold(one, f"{delivery}/{b}")
    return keyed, ledger.read()


def fold_copies(df: DataFrame, batches: int = 2, path: str | None = None, delivery: str = "all") -> DataFrame:
    """(rep, copies): one row per distinct record with its number of copies; rep is the smallest rec_id.

    NULL source, conversation or meta are values of their own. ``rec_id`` must be unique and not NULL. An empty
    table gives an empty ledger. The table is folded in as ``batches`` batches; the result is the same for
    any number of them. With ``path`` the ledger there is taken up and kept: ``df`` is a new ``delivery``, and the
    result covers everything ever folded in.
    """
    return _folded(df, batches, path, delivery)[1].select("rep", "copies")


def copy_pairs(df: DataFrame, batches: int = 2, path: str | None = None, delivery: str = "all") -> DataFrame:
    """(rec_id_a, rec_id_b): each row that is not the earliest of its record, with that earliest row.

    With ``path`` the rows of ``df`` are compared with those of earlier deliveries too.
    """
    keyed, ledger = _folded(df, batches, path, delivery)
    several = ledger.where(F.col("copies") > 1).select("key", "copies", "rep")
    pairs = join_counted(keyed, several, ["key"], "copies", F.col("rec_id"), hot_threshold(several, "copies"))
    return pairs.where(F.col("rec_id") != F.col("rep")).select(F.col("rep").alias("rec_id_a"), F.col("rec_id").alias("rec_id_b"))
