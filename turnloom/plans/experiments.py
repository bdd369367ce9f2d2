"""Experiments: which rows, view and representation each classification job reads, and the drivers that run them.

Jobs are configuration. A driver gets its rows and fits as DataFrames and functions, so that it runs on any corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators import metrics as M
from turnloom.operators import probe as P
from turnloom.operators import taxonomy as X
from turnloom.operators.curation import SOURCES, SPLITS

# Source sets of the jobs.
BINARY = (("wildchat_1m", "wildchat_4p8m"), ("lmsys", "arena_2025"), ("sharechat", "sharegpt"))
FOCAL = ("wildchat_1m", "lmsys", "sharechat")
TERNARY = (
    FOCAL, ("wildchat_1m", "lmsys", "hh_rlhf"), ("wildchat_1m", "wildchat_4p8m", "sharegpt"),
    ("wildchat_4p8m", "lmsys", "hh_rlhf"), ("wildchat_4p8m", "lmsys", "sharechat"),
)
FRACTIONS = (0.01, 0.05, 0.1, 0.25, 0.5)
# Representations; layers of the decoders, and (model, context, pooling) of other encoders.
EMBED_MODEL = "Qwen/Qwen2.5-7B"
LAYERS = {
    "Qwen/Qwen2.5-0.5B": (6, 12, 18, 24), "Qwen/Qwen2.5-1.5B": (6, 12, 18, 28), "Qwen/Qwen2.5-3B": (9, 18, 27, 36),
    "Qwen/Qwen2.5-7B": (6, 12, 18, 28), "Qwen/Qwen2.5-14B": (12, 24, 36, 48),
}
ENCODERS = {
    "bert_tiny": ("google/bert_uncased_L-2_H-128_A-2", 512, "cls"),
    "minilm": ("sentence-transformers/all-MiniLM-L6-v2", 512, "mean_normalized"),
    "deberta": ("microsoft/deberta-v3-small", 512, "cls"),
    "modernbert": ("answerdotai/ModernBERT-base", 8192, "cls"),
}
# Facets that are matched one after another, and the sources of the matching experiments.
FACETS = ("function", "topic", "multiturn", "structure")
MATCHED = ("wildchat_1m", "lmsys", "sharegpt")
# Synthetic sets: (user model A, user model B, intent source); (intent source, user model); assistants.
SYNTHETIC_PAIRS = (
    ("wildchat_1m", "wildchat_4p8m", "hh_rlhf"), ("wildchat_4p8m", "lmsys", "wildchat_1m"), ("wildchat_4p8m", "sharechat", "wildchat_1m"),
    ("lmsys", "sharechat", "wildchat_4p8m"), ("lmsys", "sharegpt", "wildchat_4p8m"), ("sharechat", "sharegpt", "lmsys"),
    ("sharechat", "arena_2025", "lmsys"), ("sharegpt", "arena_2025", "sharechat"), ("sharegpt", "hh_rlhf", "sharechat"),
    ("arena_2025", "hh_rlhf", "sharegpt"),
)
COMBINATIONS = (
    ("hh_rlhf", "wildchat_1m"), ("hh_rlhf", "wildchat_4p8m"), ("hh_rlhf", "lmsys"), ("wildchat_1m", "wildchat_4p8m"), ("wildchat_1m", "lmsys"),
    ("wildchat_1m", "sharechat"), ("wildchat_4p8m", "lmsys"), ("wildchat_4p8m", "sharechat"), ("wildchat_4p8m", "sharegpt"), ("lmsys", "sharechat"),
    ("lmsys", "sharegpt"), ("lmsys", "arena_2025"), ("sharechat", "sharegpt"), ("sharechat", "arena_2025"), ("sharechat", "hh_rlhf"),
    ("sharegpt", "arena_2025"), ("sharegpt", "hh_rlhf"),
)
ASSISTANTS = {"qwen3p5-9b": "Qwen/Qwen3.5-9B", "llama3p1-8b-instruct": "meta-llama/Llama-3.1-8B-Instruct", "qwen2p5-14b-instruct": "Qwen/Qwen2.5-14B-Instruct"}


@dataclass(frozen=True)
class Job:
    """One job: rows of ``sources`` in a view and representation, a nested fraction of the training rows, or counts only."""

    name: str
    sources: tuple[str, ...]
    view: str = "full_masked"
    lowercase: bool = False
    markers: bool = False
    fraction: float = 1.0
    model: str = EMBED_MODEL
    counts: tuple[str, ...] = ()


#: The catalogue, family by family.
JOBS: dict[str, Job] = {
    job.name: job
    for family in (
        [Job("binary_" + "__".join(s), s) for s in BINARY],
        [Job("ternary_" + "__".join(s), s) for s in TERNARY],
        [Job(f"incremental_{k}", SOURCES[:k]) for k in range(3, 1 + len(SOURCES))],
        [Job("focal_full_unmasked", FOCAL, view="full_unmasked"), Job("focal_original", FOCAL, markers=True),
         Job("focal_lowercase", FOCAL, lowercase=True), Job("focal_first_turn", FOCAL, view="first_turn")],
        [Job("structure_turns", FOCAL, counts=("turns",)), Job("structure_turns_words", FOCAL, counts=("turns", "words"))],
        [Job(f"size_{f:g}", FOCAL, fraction=f) for f in FRACTIONS],
        [Job("qwen_" + m.rpartition("-")[2], FOCAL, model=m) for m in LAYERS if m != EMBED_MODEL],
        [Job(f"encoder_{k}", FOCAL, model=m) for k, (m, _, _) in ENCODERS.items()],
    )
    for job in family
}


def select(patterns: list[str]) -> list[Job]:
    """Jobs whose name matches any glob, in catalogue order; an error when none does."""
    got = [j for j in JOBS.values() if any(fnmatch(j.name, p) for p in patterns)]
    if not got:
        raise ValueError(f"no job matches {patterns}")
    return got


def source_pairs(sources: tuple[str, ...] = SOURCES) -> list[tuple[str, str]]:
    return list(combinations(sources, 2))


def model_tag(model: str) -> str:
    """A model's name as one part of a path."""
    return "--".join(model.split("/"))


def assistant_tag(model: str) -> str:
    return model.rpartition("/")[2].lower().replace(".", "p")


def user_family(base_model: str) -> str:
    return "llama3" if "llama" in base_model.lower() else "qwen2.5"


def synthetic_name(intent_source: str, user_source: str, assistant: str, base_model: str = "meta-llama/Meta-Llama-3-8B") -> str:
    return f"synth_{intent_source}--user_{user_source}_{user_family(base_model)}--assistant_{assistant}"


def one_against_rest(rows: DataFrame, target: str, by: str = "source", out: str = "label") -> DataFrame:
    """Rows of all sources with label 1 for the target's and 0 for the donors'."""
    return rows.withColumn(out, (F.col(by) == target).cast("int"))


def run_probe(rows: DataFrame, classes: int, evaluated: DataFrame | None = None) -> dict:
    """Fit the probe grid on (feature, split, label, v), select by validation, score on test and on ``evaluated`` rows.

    Gives {feature, decay, score, head, test, eval}: test and eval are rows of :func:`metrics.scores`.
    """
    best, head = P.select_head(P.fit_grid(rows.where(F.col("split").isin("train", "val")), classes))

    def scored(part: DataFrame) -> dict:
        guess = M.argmax(M.logits(F.col("v"), head)).alias("guess")
        return M.scores(part.where(F.col("feature") == best["feature"]).select("label", guess), "label", "guess", classes).first().asDict()

    out = {**best, "head": head, "test": scored(rows.where(F.col("split") == "test"))}
    return out if evaluated is None else {**out, "eval": scored(evaluated)}


def confusion_report(rows: DataFrame, truth: str, guess: str, classes: int) -> DataFrame:
    """(truth, guess, n, share): the confusion matrix with each row's shares; a class without rows has shares 0."""
    cm = M.confusion(rows, truth, guess, classes)
    total = cm.groupBy("truth").agg(F.sum("n").alias("t"))
    return cm.join(F.broadcast(total), "truth").select("truth", "guess", "n", (F.col("n") / F.greatest(F.col("t"), F.lit(1))).alias("share"))  # classes squared


def matched_rows(a: DataFrame, b: DataFrame, facets: tuple[str, ...], seed: str) -> DataFrame:
    """Rows (conv_id, side) of two cohorts kept by the largest match on the facets: equal numbers, equal totals of each feature.

    Cohorts have conv_id and, per facet, an ARRAY<INT> of its name and (but for ``structure``) a flag <facet>_complete;
    conversations that are not complete are not matched. An empty cohort is an error.
    """
    sides = {}
    for name, df in (("a", a), ("b", b)):
        whole = [F.col(f"{f}_complete") for f in facets if f != "structure"]
        for cond in whole:
            df = df.where(cond)
        sides[name] = df.select("conv_id", F.concat(*[F.col(f) for f in facets]).alias("vector"))
        if sides[name].isEmpty():
            raise ValueError("a cohort has no complete conversation")
    cells = sorted((tuple(r["vector"]), r["n_a"], r["n_b"]) for r in X.match_cells(sides["a"], sides["b"]).collect())
    picks = X.maximum_match(cells)
    spark = a.sparkSession
    out = None
    for k, name in enumerate(("a", "b")):
        quotas = spark.createDataFrame([(list(c[0]), p[k]) for c, p in zip(cells, picks)], "vector array<int>, quota bigint")
        one = X.pick_rows(sides[name], quotas, ["vector"], "conv_id", f"{seed}:{name}").select("conv_id", F.lit(name).alias("side"))
        out = one if out is None else out.unionByName(one)
    return out


def forward_matching(cohorts: Callable[[str, str], DataFrame], probe: Callable[[tuple[str, str], DataFrame | None], float], sources: tuple[str, ...] = MATCHED) -> list[dict]:
    """[{pair, condition, accuracy, sizes}]: the probe on the whole cohorts, then on ones matched on more and more facets.

    ``cohorts(source, split)`` gives the features, ``probe(pair, rows)`` fits on the rows (split, conv_id, side) and
    gives the test accuracy; None stands for all rows.
    """
    table = []
    for pair in source_pairs(sources):
        table.append({"pair": pair, "condition": (), "accuracy": probe(pair, None), "sizes": {}})
        for k in range(1, len(FACETS) + 1):
            kept, sizes = None, {}
            for split in SPLITS:
                one = matched_rows(*[cohorts(s, split) for s in pair], FACETS[:k], split).withColumn("split", F.lit(split))
                sizes[split] = one.where("side = 'a'").count()
                kept = one if kept is None else kept.unionByName(one)
            table.append({"pair": pair, "condition": FACETS[:k], "accuracy": probe(pair, kept), "sizes": sizes})
    return table


def fingerprint_pairs(accuracy: Callable[[list[str], list[str] | None], tuple[float, float | None]], assistant: str) -> list[dict]:
    """Per user-model pair the accuracies real to real, real to synthetic and synthetic to synthetic.

    ``accuracy(train sets, evaluated sets)`` gives (test accuracy, accuracy on the evaluated sets).
    """
    out = []
    for a, b, intents in SYNTHETIC_PAIRS:
        made = [synthetic_name(intents, user, assistant) for user in (a, b)]
        real, crossed = accuracy([a, b], made)
        out.append({"pair": (a, b), "intents": intents, "real_to_real": real, "real_to_synth": crossed, "synth_to_synth": accuracy(made, None)[0]})
    return out


#: Conditions of the assistants experiment: view, and which conversations by their number of user turns.
TURN_CONDITIONS = {"all": ("full_masked", None), "single_turn": ("full_masked", "single"), "multi_turn": ("full_masked", "multi"), "assistant_only": ("user_masked", None)}


def turn_filter(which: str | None, n_user_turns: Column) -> Column:
    return F.lit(True) if which is None else (n_user_turns == 1) == F.lit(which == "single")


def assistant_comparisons(balanced: Callable[[list[str], str, str | None], float]) -> list[dict]:
    """Every comparison of assistants under every condition, over all combinations: one row each with its score."""
    tags = list(ASSISTANTS)
    return [
        {"comparison": " vs. ".join(group), "condition": name, "intents": intents, "user": user, "chance": 1.0 / len(group),
         "score": balanced([synthetic_name(intents, user, t) for t in group], view, turns)}
        for group in [*map(list, combinations(tags, 2)), tags]
        for name, (view, turns) in TURN_CONDITIONS.items()
        for intents, user in COMBINATIONS
    ]


def score_ranges(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, low, mean, high) of a score over combinations."""
    return rows.groupBy(*by).agg(F.min(score).alias("low"), F.avg(score).alias("mean"), F.max(score).alias("high"))


def selection_gains(kl: DataFrame, nll: DataFrame) -> DataFrame:
    """(target, pct, delta_kl, delta_nll): how much selected donors beat random ones, in divergence and in loss.

    ``kl`` and ``nll`` are (target, pct, method in dsir/random, value), one row each; small tables of results.
    """

    def gain(df: DataFrame, out: str) -> DataFrame:
        value = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
        return df.groupBy("target", "pct").agg((value("random") - value("dsir")).alias(out))

    return gain(kl, "delta_kl").join(gain(nll, "delta_nll"), ["target", "pct"])
