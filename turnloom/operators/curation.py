"""Curation: dedup, template filter, cross-source texts, connected groups, split assignment, corpus checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators.graph import connected_components, star_links
from turnloom.ranking import hash_rank, hex_bucket, running_before
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

# Sources in order, split names, bit of each split, first source placed, source kept whole.
SOURCES = ("wildchat_1m", "wildchat_4p8m", "lmsys", "arena_2025", "sharechat", "sharegpt", "hh_rlhf")
SPLITS = ("train", "val", "test")
SPLIT_BITS = {"train": 1, "val": 2, "test": 4}
KEPT_WHOLE = ("sharegpt",)
MIN_SHARED_WORDS = 5
#: Common n-grams (16 bytes of hash and a source each) that are broadcast.
BROADCAST_GRAMS = 500_000


@dataclass(frozen=True)
class CurationConfig:
    """Parameters of the build; the defaults are the reference's sizes."""

    sizes: dict[str, int] = field(default_factory=lambda: {"train": 40000, "val": 3000, "test": 7000})
    ngram: int = 7
    template_limit: int = 100
    seed: str = "42"
    #: With a percentage, a source's sizes are that share of its records, in the proportions of ``sizes``.
    percent: int | None = None

    def caps(self, source: str, n: int) -> dict[str, int]:
        """Records of each split of a source with ``n`` eligible records."""
        if source in KEPT_WHOLE:
            return whole_source_caps(n, self.sizes)
        if self.percent is None:
            return self.sizes
        return {s: n * self.percent * k // (100 * sum(self.sizes.values())) for s, k in self.sizes.items()}


def group_namespace(source: Column) -> Column:
    return F.when(source.startswith("wildchat"), F.lit("wildchat")).otherwise(source)


def allowed_mask(source: Column, presplit: Column) -> Column:
    """Bit mask of the splits a record may enter (train 1, val 2, test 4)."""
    return F.when(source != "hh_rlhf", F.lit(7)).when(presplit.eqNullSafe(F.lit("test")), F.lit(4)).otherwise(F.lit(3))


def first_seen(df: DataFrame, keys: list[str], row_id: str, carry: bool = False) -> DataFrame:
    """Rows with the smallest ``row_id`` of their key; the rest are later copies.

    A minimum per key (combined map-side) and a semi join on the unique id stand for a window, so a key with a
    third of all rows is no hot task. With ``carry`` the row travels with the minimum instead of being joined:
    right for few narrow columns that cost much to compute. Rows with equal NULL keys count as copies of each other.
    """
    if carry:
        return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), row_id).alias("r")).select("r.*")
    first = df.groupBy(*keys).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(first, row_id, "left_semi")


def ngram_counts(df: DataFrame, text: Column, n: int, by: str = "source") -> DataFrame:
    """(by, gram, n): occurrences of word n-grams, repeats inside one text included."""
    return df.select(by, F.explode(T.word_ngrams(text, n)).alias("gram")).groupBy(by, "gram").agg(F.count("*").alias("n"))


def template_rows(df: DataFrame, text: Column, n: int, limit: int, row_id: str, by: str = "source") -> DataFrame:
    """(row_id) of rows with an n-gram that occurs more than ``limit`` times in their source.

    N-grams are compared by 128 bits of hash of their words, so no n-gram text is built or shuffled.
    """

    def hashes(w: Column) -> Column:
        every = F.transform(
            F.sequence(F.lit(1), F.size(w) - n + 1),
            lambda i: F.struct(F.xxhash64(F.slice(w, i, n)).alias("a"), F.xxhash64(F.lit(n), F.slice(w, i, n)).alias("b")))
        return F.when(F.size(w) >= n, every)

    stage = Stage(df.sparkSession, "templates")
    grams = df.select(row_id, by, F.explode(T.let(T.words(F.lower(text)), hashes)).alias("g")).select(row_id, by, "g.a", "g.b")
    common = grams.groupBy(by, "a", "b").agg(F.count("*").alias("c")).where(F.col("c") > limit)
    common = stage.write(common.select(by, "a", "b"), "common")
    # few as a rule (each stands in more than ``limit`` places): then they travel, and the n-grams are not shuffled again
    common = F.broadcast(common) if common.count() <= BROADCAST_GRAMS else common
    return grams.join(common, [by, "a", "b"], "left_semi").select(row_id).distinct()


def shared_texts(df: DataFrame, key: str = "clean_user_hash", words: str = "clean_words") -> DataFrame:
    """(key) of user texts of MIN_SHARED_WORDS words or more that occur in several sources."""
    long_enough = df.where(F.col(words) >= MIN_SHARED_WORDS)
    return long_enough.groupBy(key).agg(F.min("source").alias("a"), F.max("source").alias("b")).where(F.col("a") != F.col("b")).select(key)


def not_in_earlier(later: DataFrame, earlier: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows of a later release whose id the earlier release does not have."""
    return later.join(earlier.select(key).distinct(), key, "left_anti")


def with_clean(df: DataFrame) -> DataFrame:
    """Add clean_conversation and the metadata of the marker-free text (clean_user_hash, clean_first_hash, ...)."""
    def described(conv: Column) -> Column:
        both = F.struct(C.user_text(conv).alias("user"), C.first_user_turn(conv).alias("first"))
        facts = lambda t: F.struct(
            conv.alias("conv"), T.md5_text(T.norm_text(t["user"])).alias("uh"), T.md5_text(T.norm_text(t["first"])).alias("fh"),
            T.word_count(t["user"]).alias("uw"), T.word_count(t["first"]).alias("fw"))
        return T.let(both, facts)

    out = df.withColumn("__clean", T.let(C.clean_conversation(F.col("conversation")), described))
    names = {"clean_conversation": "conv", "clean_user_hash": "uh", "clean_first_hash": "fh", "clean_words": "uw", "clean_first_words": "fw"}
    return out.select(*df.columns, *[F.col(f"__clean.{v}").alias(k) for k, v in names.items()])


def released_labels(meta: Column) -> Column:
    """The label list in a record's meta; NULL where there is none or it is no list."""
    return F.from_json(meta, "user_language_labels array<string>")["user_language_labels"]


def labels_all_english(labels: Column) -> Column:
    """True where a label list is not empty and holds English labels only."""
    return F.coalesce((F.size(labels) > 0) & F.forall(labels, lambda x: F.coalesce(x.isin(*C.ENGLISH_LABELS), F.lit(False))), F.lit(False))


def filter_records(stage: Stage, records: DataFrame, config: CurationConfig) -> tuple[DataFrame, DataFrame]:
    """(kept, counters): the per-source filters in the reference's order.

    Superseded ids, mixed-language and ambiguous conversations, repeated user texts (first seen wins, before the
    template filter, so a dropped template still claims its hash), templates, conversations emptied by marker
    deletion, repeats after it, and texts shared by several sources. ``records`` needs rec_id, source, conv_id,
    group_id, presplit, conversation, meta, user_text_hash; ``ambiguous`` (BOOLEAN) is used where present.
    """
    base = records.withColumn("presplit", F.when(F.col("source") == "hh_rlhf", F.col("presplit")))
    base = base.where(C.rejection_reason(F.col("conversation")).isNull())
    earlier = base.where(F.col("source") == "wildchat_1m").select("conv_id").distinct()
    base = base.where(F.col("source") != "wildchat_4p8m").unionByName(base.where(F.col("source") == "wildchat_4p8m").join(earlier, "conv_id", "left_anti").select(*base.columns))
    labels = released_labels(F.col("meta"))
    chosen = (F.col("source") != "sharechat") | labels_all_english(labels)
    if "ambiguous" in records.columns:
        chosen = chosen & ((F.col("source") != "sharechat") | ~F.coalesce("ambiguous", F.lit(False)))
    base = stage.write(base.where(chosen), "chosen")
    unique = stage.write(first_seen(base, ["source", "user_text_hash"], "rec_id"), "unique")
    bad = template_rows(unique, C.first_user_turn(F.col("conversation")), config.ngram, config.template_limit, "rec_id")
    plain = stage.write(with_clean(unique.join(bad, "rec_id", "left_anti")), "plain")
    whole = plain.where(C.rejection_reason(F.col("clean_conversation")).isNull())
    whole = stage.write(first_seen(whole, ["source", "clean_user_hash"], "rec_id"), "whole")
    kept = stage.write(whole.join(shared_texts(whole), "clean_user_hash", "left_anti"), "kept")
    steps = (("english", records), ("chosen", base), ("after_exact_dedup", unique), ("after_template_filter", plain), ("after_marker_deletion", whole), ("eligible", kept))
    counters = None
    for name, df in steps:
        one = df.groupBy("source").agg(F.count("*").alias("n")).select("source", F.lit(name).alias("stage"), "n")
        counters = one if counters is None else counters.unionByName(one)
    return kept, counters


def link_groups(stage: Stage, kept: DataFrame) -> DataFrame:
    """(rec_id, component): records linked by user, full user text, or an opening prompt of five words or more.

    ``kept`` needs rec_id, source, group_id and the clean_* columns. Unlinked records are their own component.
    """
    keys = F.array(
        F.struct(F.lit("group").alias("kind"), F.concat_ws("\x01", group_namespace(F.col("source")), "group_id").alias("key")),
        F.struct(F.lit("user").alias("kind"), F.col("clean_user_hash").alias("key")),
        F.struct(F.lit("first").alias("kind"), F.when(F.col("clean_first_words") >= MIN_SHARED_WORDS, F.col("clean_first_hash")).alias("key")),
    )
    keyed = kept.select(F.col("rec_id").alias("id"), F.explode(keys).alias("k")).select("id", "k.kind", "k.key")
    labels = connected_components(stage, stage.write(star_links(stage, keyed), "links"))
    out = kept.select("rec_id").join(labels, F.col("rec_id") == F.col("node"), "left")
    return out.select("rec_id", F.coalesce("component", "rec_id").alias("component"))


def constraint_masks(df: DataFrame) -> DataFrame:
    """(component, mask, conflict): splits every member allows; none in common forces test."""
    both = df.groupBy("component").agg(F.bit_and(allowed_mask(F.col("source"), F.col("presplit"))).alias("m"))
    return both.select("component", F.when(F.col("m") == 0, F.lit(4)).otherwise(F.col("m")).alias("mask"), (F.col("m") == 0).alias("conflict"))


def whole_source_caps(n: int, sizes: dict[str, int]) -> dict[str, int]:
    """Caps of a source that keeps all its records, in the proportion of ``sizes`` (round half to even)."""
    total = sum(sizes.values())
    caps = {s: round(n * sizes[s] / total) for s in ("val", "test")}
    return {"train": n - caps["val"] - caps["test"], **caps}


def _bit(mask: str, split: str) -> Column:
    return F.col(mask).bitwiseAND(F.lit(SPLIT_BITS[split])) != 0


def assign_splits(stage: Stage, kept: DataFrame, components: DataFrame, config: CurationConfig) -> DataFrame:
    """(rec_id, source, component, split, chosen): groups are placed source by source, then cut to exact sizes.

    Within a source, groups come in hash order; test is filled, then val: a free, permitted group is taken while
    the records before it (assigned ones first) are fewer than the cap, so a split may overshoot by one group.
    The rest is train. Placements hold for later sources.

    A source leaves none of its groups open, so a group is decided at the first source that has it, and there by its
    running sums alone. These are computed for all sources in one bucketed pass. From source to source only numbers
    go on: how many of its records earlier decisions have put into test and val, and how many that val may hold went to test.
    """
    rows = kept.select("rec_id", "source", "presplit").join(components, "rec_id")
    masks = constraint_masks(rows)
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    info = stage.write(masks.join(sizes, "component"), "groups")
    threshold = hot_threshold(info, "n")
    rows = join_counted(rows, info, ["component"], "n", F.col("rec_id"), threshold)
    own = allowed_mask(F.col("source"), F.col("presplit"))
    rows = stage.write(rows.where(own.bitwiseAND(F.col("mask")) != 0).drop("n", "conflict"), "rows")
    order = (*KEPT_WHOLE, *(s for s in SOURCES if s not in KEPT_WHOLE))
    turn = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    groups = rows.groupBy("source", "component").agg(F.count("*").alias("n"), F.min("mask").alias("mask"))
    single = F.when(F.col("mask") == 4, "test").when(F.col("mask") == 2, "val").when(F.col("mask") == 1, "train")
    groups = groups.select("*", turn.alias("turn"), single.alias("fixed"), T.hash_order(config.seed, F.concat_ws(":", "source", "component")).alias("h"))
    of_group = Window.partitionBy("component")  # as many rows as sources
    groups = stage.write(groups.withColumn("first", F.min("turn").over(of_group)), "by_source")
    free = groups.where(F.col("fixed").isNull())
    amount = lambda cond: F.when(cond, F.col("n")).otherwise(0)
    sums = {"rt": amount(_bit("mask", "test")), "rv": amount(_bit("mask", "val")), "rb": amount(_bit("mask", "test") & _bit("mask", "val"))}
    decided = running_before(free.where(F.col("turn") == F.col("first")), ["source"], hex_bucket("h"), ["h", "component"], sums)
    decided = stage.write(decided.select("turn", "first", "component", "n", "mask", *sums), "decided")
    later = free.where(F.col("turn") > F.col("first")).select("turn", "component", "n")
    later = stage.write(later.join(decided.select("first", "component", "mask", *sums), "component"), "later")
    totals = {r["source"]: r["n"] for r in groups.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    given = {(r["turn"], r["fixed"]): r["n"] for r in groups.where(F.col("fixed").isNotNull()).groupBy("turn", "fixed").agg(F.sum("n").alias("n")).collect()}

    split: Column = F.lit(None).cast("string")
    for k, src in enumerate(order, 1):
        if src not in totals:
            continue
        caps = config.caps(src, totals[src])
        placed = {r["s"]: r["n"] for r in later.where(F.col("turn") == k).groupBy(split.alias("s")).agg(F.sum("n").alias("n")).collect()}
        room = {s: caps[s] - given.get((k, s), 0) - placed.get(s, 0) for s in ("test", "val")}
        open_ = F.col("rt") < F.lit(room["test"])
        both = decided.where((F.col("turn") == k) & _bit("mask", "test") & _bit("mask", "val") & open_).agg(F.sum("n")).first()[0] or 0
        to_test = _bit("mask", "test") & open_
        before = F.col("rv") - F.when(open_, F.col("rb")).otherwise(F.lit(both))
        here = F.when(to_test, "test").when(_bit("mask", "val") & (before < F.lit(room["val"])), "val").otherwise("train")
        split = F.when(F.col("first") == k, here).otherwise(split)
    fixed = info.select("component", "n", single.alias("split")).where(F.col("split").isNotNull())
    named = decided.select("component", split.alias("split")).join(info.select("component", "n"), "component").unionByName(fixed)
    rows = join_counted(rows, stage.write(named, "named"), ["component"], "n", F.col("rec_id"), threshold).drop("n")
    rows = rows.withColumn("h", T.hash_order(config.seed, F.col("rec_id")))
    ranked = hash_rank(stage.write(rows, "assigned"), ["source", "split"], "h", ["rec_id"])
    cap = F.lit(0)
    for src, n in totals.items():
        for s, most in config.caps(src, n).items():
            cap = F.when((F.col("source") == src) & (F.col("split") == s), F.lit(most)).otherwise(cap)
    return ranked.select("rec_id", "source", "component", "split", (F.col("source").isin(*KEPT_WHOLE) | (F.col("rank") <= cap)).alias("chosen"))


def corpus_violations(corpus: DataFrame) -> DataFrame:
    """(rule, key): what breaks the corpus rules; empty for a sound corpus.

    ``corpus`` needs rec_id, source, split, conv_id, group_id, presplit and the clean_* columns. Rules: structure,
    unique ids and user texts per source, permitted splits, no long text in two sources, and no user, user text
    or long opening prompt in two splits.
    """
    reason = C.rejection_reason(F.col("clean_conversation"))
    bit = F.lit(0)
    for s, b in SPLIT_BITS.items():
        bit = F.when(F.col("split") == s, F.lit(b)).otherwise(bit)
    rid = F.col("rec_id").cast("string")
    first = F.when(F.col("clean_first_words") >= MIN_SHARED_WORDS, F.col("clean_first_hash"))
    user = F.concat_ws("\x01", group_namespace(F.col("source")), "group_id")

    def crossing(rule: str, key: Column) -> DataFrame:
        by = corpus.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min("split").alias("a"), F.max("split").alias("b"))
        return by.where(F.col("a") != F.col("b")).select(F.lit(rule).alias("rule"), "key")

    def repeated(rule: str, key: str) -> DataFrame:
        return corpus.groupBy("source", key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.lit(rule).alias("rule"), F.col(key).alias("key"))

    return (
        corpus.where(reason.isNotNull()).select(F.lit("structure").alias("rule"), rid.alias("key"))
        .union(corpus.where(allowed_mask(F.col("source"), F.col("presplit")).bitwiseAND(bit) == 0).select(F.lit("split"), rid))
        .union(repeated("repeated id", "conv_id")).union(repeated("repeated text", "clean_user_hash"))
        .union(shared_texts(corpus).select(F.lit("shared text"), "clean_user_hash"))
        .union(crossing("user crosses", user)).union(crossing("text crosses", F.col("clean_user_hash"))).union(crossing("opening crosses", first))
    )


def build_corpus(records: DataFrame, config: CurationConfig = CurationConfig(), strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(corpus, counters): filters, groups and splits in one call; the corpus has split and the clean_* columns.

    With ``strict`` a source with fewer records in a split than its size is an error, as in the reference's build.
    """
    stage = Stage(records.sparkSession, "curation")
    kept, counters = filter_records(stage, records, config)
    splits = stage.write(assign_splits(stage, kept, stage.write(link_groups(stage, kept), "components"), config), "splits")
    if strict:
        pools = {(r["source"], r["split"]): r["n"] for r in splits.groupBy("source", "split").agg(F.count("*").alias("n")).collect()}
        for src in {s for s, _ in pools} - set(KEPT_WHOLE):
            caps = config.caps(src, sum(n for (s, _), n in pools.items() if s == src))
            short = {s: (pools.get((src, s), 0), most) for s, most in caps.items() if pools.get((src, s), 0) < most}
            if short:
                raise ValueError(f"{src}: fewer records than wanted (has, wants): {short}")
    return kept.join(splits.where("chosen").select("rec_id", "split"), "rec_id"), counters


def nested_fraction(df: DataFrame, parts: list[str], row_id: str, fraction: float, seed: str) -> DataFrame:
    """The first round(n * fraction) rows of each group in hash order; smaller fractions are subsets of larger."""
    ranked = hash_rank(df.withColumn("__h", T.hash_order(seed, F.col(row_id))), parts, "__h", [row_id])
    sizes = df.groupBy(*parts).agg(F.count("*").alias("__n"))
    return ranked.join(sizes, parts).where(F.col("rank") <= F.bround(F.col("__n") * F.lit(fraction), 0)).select(*df.columns)


def sessions_longest(df: DataFrame, session: str, order: list[Column]) -> DataFrame:
    """One row per session: the one with the greatest order tuple (a max of structs, combined map-side)."""
    best = F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row")))
    return df.groupBy(F.col(session).alias("__s")).agg(best.alias("b")).select("b.row.*")


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """(n, digest): order-free fingerprint, the sum of 52-bit md5 prefixes of the rows' JSON."""
    h = F.conv(F.substring(F.md5(F.to_json(F.struct(*df.columns))), 1, 13), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h).cast("string"), F.lit("0")).alias("digest"))
