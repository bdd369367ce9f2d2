import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.functions import stats
from turnloom.operators import metrics as M
from turnloom.operators import probe as P
from turnloom.operators import selection as S
from turnloom.operators import sft
from turnloom.operators import tasks as K
from turnloom.operators import taxonomy as X
from turnloom.plans import experiments


def test_unit_bins_at_edges(spark):
    scores = [0.0, 0.05, 0.15, 0.3, 0.35, 0.6, 0.7, 1.0]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").select(M.unit_bin(F.col("s"), 20)).collect()]
    edges = np.linspace(0, 1, 21)
    assert got == [min(int(np.searchsorted(edges, s, side="right")) - 1, 19) for s in scores]


def test_weighted_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.gauss(0, 1), 1 if i % 2 else 4), rng.random()) for i in range(400)]
    total = sum(r[2] for r in rows)
    rows = [(i, x, w / total) for i, x, w in rows]
    got = M.weighted_quantile_edges(spark.createDataFrame(rows, "i bigint, x double, w double"), "x", "w", "i", 20)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    expect = np.unique(np.interp(np.arange(1, 20) / 20, np.cumsum([r[2] for r in order]), [r[1] for r in order]))
    assert np.allclose(got, expect)


def test_heads_softmax_and_scores(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0]), (2, [5.0, 5.0])], "label int, v array<double>")
    head = M.LinearHead([[1.0, 0.0], [0.0, 1.0], [-1.0, -1.0]], [0.0, 0.0, 0.5], [0.0, 0.0], [1.0, 2.0])
    got = df.withColumn("z", M.logits(F.col("v"), head)).select("label", "z", M.argmax(F.col("z")).alias("guess"), M.softmax(F.col("z")).alias("p"))
    for r, v in zip(got.collect(), ([1, 0], [0.9, 0.1], [0, 1], [5, 5])):
        z = np.array([v[0], v[1] / 2, -v[0] - v[1] / 2 + 0.5])
        assert np.allclose(r["z"], z) and r["guess"] == int(z.argmax()) and np.allclose(r["p"], np.exp(z) / np.exp(z).sum())
    s = M.scores(got, "label", "guess", 4).first()
    assert s["n"] == 4 and abs(s["balanced_accuracy"] - np.mean([1, 1, 0])) < 1e-12
    assert {r["label"]: r["recall"] for r in M.recalls(got, "label", "guess", 4).collect()}[3] == 0
    w = {r["label"]: r["weight"] for r in M.class_weights(df, "label", 4).collect()}
    raw = np.array([2, 1, 1, 1.0])
    raw = raw.sum() / (4 * raw)
    assert np.allclose([w[i] for i in range(4)], raw / raw.mean())


def test_statistics_without_scipy():
    assert abs(stats.t_quantile(0.95, 99) - 1.660391156) < 1e-8 and abs(stats.t_quantile(0.95, 9) - 1.833112933) < 1e-8
    assert abs(stats.correlation_p(0.5, 10) - 0.1411) < 1e-4 and stats.correlation_p(1.0, 5) == 0.0
    assert math.isnan(stats.t_quantile(0.95, 0)) and math.isnan(stats.correlation_p(0.3, 2))


def test_probe_learns_and_is_selected(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = i % 2
        rows.append(("good", "train" if i < 160 else "val", y, (rng.normal(size=4) + 3 * y).tolist()))
        rows.append(("noise", "train" if i < 160 else "val", y, rng.normal(size=4).tolist()))
    df = spark.createDataFrame(rows, "feature string, split string, label int, v array<double>")
    info, head = P.select_head(P.fit_grid(df, 2))
    assert info["feature"] == "good" and info["score"] > 0.95
    guess = df.where("feature = 'good'").select("label", M.argmax(M.logits(F.col("v"), head)).alias("g"))
    assert M.scores(guess, "label", "g", 2).first()["accuracy"] > 0.95
    model = P.fit_scalable(df.where("feature = 'good'"), 2)
    assert model.summary.accuracy > 0.95


def test_log_and_categories(spark):
    log = spark.createDataFrame(
        [("a", 0, ["x"], 0.9, "error", 1), ("a", 0, ["x", "zz"], 0.9, "accepted", 5), ("b", 0, ["y"], 0.9, "accepted", 2), ("b", 1, ["y"], 0.1, "low_confidence", 3),
         ("c", 0, None, None, "invalid", 4)], "conversation_id string, turn int, labels array<string>, confidence double, status string, seq bigint")
    units = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("c", 0), ("d", 0)], "conversation_id string, turn int")
    h = spark.createDataFrame([("P", "x"), ("Q", "y")], "parent string, child string")
    got = {r["conversation_id"]: (r["complete"], r["categories"], r["vector"]) for r in X.conversation_categories(units, log, h, ["P", "Q"]).collect()}
    assert got == {"a": (True, ["P"], [1, 0]), "b": (False, ["Q"], [0, 1]), "c": (False, [], [0, 0]), "d": (False, [], [0, 0])}
    todo = {(r[0], r[1]) for r in X.todo(units, log, ["conversation_id", "turn"]).collect()}
    again = {(r[0], r[1]) for r in X.todo(units, log, ["conversation_id", "turn"], retry=True).collect()}
    assert todo == {("d", 0)} and again == {("d", 0), ("c", 0)}
    judged = [r[0] for r in log.orderBy("seq").select(X.judged_status(F.col("labels"), F.col("confidence"), ["x", "y"], 0.7)).collect()]
    assert judged == ["accepted", "accepted", "low_confidence", "invalid", "invalid"]


def brute_match(cells):
    best = 0

    def go(i, size, balance):
        nonlocal best
        if i == len(cells):
            if not any(balance):
                best = max(best, size)
            return
        vec, a, b = cells[i]
        for x in range(a + 1):
            for y in range(b + 1):
                go(i + 1, size + x, [s + (x - y) * v for s, v in zip(balance, (1, *vec))])

    go(0, 0, [0] * (1 + len(cells[0][0])))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_maximum_match_equals_brute_force(seed):
    rng = random.Random(seed)
    cells = [((x, y), rng.randint(0, 3), rng.randint(0, 3)) for x in (0, 1) for y in (0, 1)]
    best = brute_match(cells)
    if not best:
        with pytest.raises(X.NotCertified, match="empty"):
            X.maximum_match(cells)
        return
    picks = X.maximum_match(cells)
    assert sum(p[0] for p in picks) == best
    for f in range(2):
        assert sum(c[0][f] * p[0] for c, p in zip(cells, picks)) == sum(c[0][f] * p[1] for c, p in zip(cells, picks))
    assert all(0 <= p[0] <= c[1] and 0 <= p[1] <= c[2] for c, p in zip(cells, picks))


@pytest.mark.parametrize("seed", range(6))
def test_maximum_match_with_counts_in_the_thousands(seed):
    rng = random.Random(seed)
    cells = [((x, y, z, w), rng.randint(0, 4000), rng.randint(0, 4000)) for x in (0, 1) for y in (0, 1) for z in (0, 1) for w in (0, 1, 2)]
    picks = X.maximum_match(cells, 60)
    for f in range(4):
        assert sum(c[0][f] * p[0] for c, p in zip(cells, picks)) == sum(c[0][f] * p[1] for c, p in zip(cells, picks))
    assert sum(p[0] for p in picks) == sum(p[1] for p in picks) >= sum(min(c[1], c[2]) for c in cells)
    # weak duality: no multipliers of the equal totals may promise less than the picks hold
    for _ in range(200):
        price = [rng.uniform(-1, 1) for _ in range(5)]
        worth = [sum(p * v for p, v in zip(price, (1, *c[0]))) for c in cells]
        assert sum(max(0, 1 - w) * c[1] + max(0, w) * c[2] for w, c in zip(worth, cells)) >= sum(p[0] for p in picks) - 1e-6


def test_maximum_match_with_structure_and_limits():
    rng = random.Random(5)
    cells = [((rng.randint(1, 8), rng.randint(5, 400), rng.randint(0, 1)), rng.randint(0, 2), rng.randint(0, 2)) for _ in range(150)]
    picks = X.maximum_match(cells, 60)
    assert sum(p[0] for p in picks) > sum(min(c[1], c[2]) for c in cells)
    with pytest.raises(X.NotCertified, match="limits"):
        X.maximum_match(cells, seconds=-1.0)


def test_score_match_and_noise(spark):
    df = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"), ((F.col("id") * 7 % 100) / 100.0).alias("s"))
    got = X.score_match(df, "c", "s", "id", 10, "1").groupBy("bin").pivot("c", ["a", "b"]).count().collect()
    assert got and all(r["a"] == r["b"] for r in got)
    ann = spark.range(101).select(F.col("id"), F.lit("g").alias("g"), F.lit(True).alias("complete"), F.array((F.col("id") % 2).cast("int"), F.lit(1)).alias("vector"))
    noise = X.noise_floor(ann, ["g"], "id", 9, "1").first()["noise"]
    assert 0 <= noise < 30


def test_selection_prefixes_and_gaps(spark):
    df = spark.range(500).withColumn("w", (F.col("id") >= 250).cast("double") * 6)
    got = S.gumbel_top(df, "w", "id", 100, "0").collect()
    assert sorted(r["position"] for r in got) == list(range(1, 101)) and sum(r["id"] >= 250 for r in got) > 80
    nll = spark.createDataFrame([(a, b, float(x)) for (a, b), x in {("p", "p"): 1, ("p", "q"): 3, ("q", "p"): 2, ("q", "q"): 1.5}.items()], "train string, test string, nll double")
    assert [tuple(r) for r in S.transfer_gaps(nll).collect()] == [("p", "q", 0.5 * ((3 - 1.5) + (2 - 1)))]


def test_flip_masks_only_user_text(spark):
    conv = [{"role": "user", "content": " hello there "}, {"role": "assistant", "content": "general text"}]
    df = spark.createDataFrame([(1, conv, "an intent"), (2, conv[:1], "an intent"), (3, conv, " "), (4, None, "x")], "i int, conversation array<struct<role:string,content:string>>, intent string")
    rows = sft.flip(df, "qwen").collect()
    assert [r["i"] for r in rows] == [1]
    r = rows[0]
    assert len(r["input_ids"]) == len(r["labels"]) and r["labels"][-1] == sft.IGNORED and r["labels"][0] == sft.IGNORED
    assert [x for x in r["labels"] if x != sft.IGNORED] == [x for x, y in zip(r["input_ids"], r["labels"]) if y != sft.IGNORED]
    assert sum(x != sft.IGNORED for x in r["labels"]) == len("hello there<|im_end|>".split()) + len("<|endconversation|><|im_end|>".split())
    labels = spark.createDataFrame([([5, -100],), ([-100, 5],), ([],), (None,)], "l array<int>").select(sft.has_target(F.col("l"))).collect()
    assert [r[0] for r in labels] == [False, True, False, False]


def test_batches_packs_and_buckets(spark):
    lengths = [3, 9, 4, 4, 10, 1, 7, 2, 8, 5]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "i bigint, n int")
    got = {}
    for r in sft.token_batches(df, "n", "i", 16, 3).collect():
        got.setdefault((r["part"], r["batch"]), []).append(r["i"])
    expect, cur = [], []
    for i in sorted(range(10), key=lambda k: (lengths[k], k)):
        if cur and (lengths[i].bit_length() != lengths[cur[0]].bit_length() or len(cur) >= 3 or (len(cur) + 1) * lengths[i] > 16):
            expect.append(cur)
            cur = []
        cur.append(i)
    assert [sorted(got[b]) for b in sorted(got)] == [sorted(b) for b in expect + [cur]]

    def packed(tail):
        out = {}
        for r in sft.packs(df, "n", "i", 12, emit_tail=tail).collect():
            out.setdefault(r["pack"], []).append(r["i"])
        return list(out.values())

    packs, buf = [], []
    for i, n in enumerate(lengths):
        if sum(lengths[k] for k in buf) + n >= 12:
            packs.append(buf)
            buf = []
        buf.append(i)
    assert packed(False) == [p for p in packs if p] and packed(True) == [p for p in packs if p] + [buf]
    with pytest.raises(Exception, match="sample too large"):
        sft.packs(df.withColumn("n", F.lit(12)), "n", "i", 12).collect()
    b = {r["i"]: (r["batch"], r["worker"]) for r in sft.length_buckets(df, "n", "i", 3, 2).collect()}
    order = sorted(range(10), key=lambda k: (lengths[k], k))
    assert b == {i: (k // 3, k // 3 % 2) for k, i in enumerate(order) if k // 3 < 2}


def test_tasks_and_intervals(spark):
    pool = spark.createDataFrame([(f"t{i}", "d") for i in range(20)], "task_id string, dataset string")
    first = spark.createDataFrame([("t3",), ("t7",), ("zz",)], "task_id string")
    got = {r["task_id"] for r in K.select_tasks(pool, first, 5, "1").collect()}
    assert len(got) == 5 and {"t3", "t7"} <= got
    faults = spark.createDataFrame([("I am here now",), ("x " * 26,), ("a b",), ("Same  words here",), ("fine words here",), (None,)], "r string").select(
        K.reply_fault(F.col("r"), F.array(F.lit("same words here")))).collect()
    assert [r[0] for r in faults] == ["first_token", "too_long", "too_short", "verbatim", None, "too_short"]
    v = spark.createDataFrame([("a", 0.1), ("a", 0.5), ("a", 0.6), ("b", 1.0)], "g string, x double")
    r = {x["g"]: x for x in K.intervals(v, ["g"], "x").collect()}
    half = stats.t_quantile(0.95, 2) * np.std([10, 50, 60], ddof=1) / math.sqrt(3)
    assert abs(r["a"]["half"] - half) < 1e-9 and r["b"]["half"] is None
    turns = spark.createDataFrame([("c", "t", 1), ("c", "t", 2)], "conv_id string, task_id string, turn int")
    grades = spark.createDataFrame([("c", 1, "ok", False), ("c", 2, "ok", True)], "conv_id string, turn int, status string, correct boolean")
    assert K.task_success(K.graded_turns(turns, grades), []).first()["success"] == 1.0
    with pytest.raises(Exception, match="ungraded"):
        K.graded_turns(turns, grades.limit(1)).collect()
    with pytest.raises(Exception, match="tasks differ"):
        K.paired_delta(pool.limit(2).withColumn("s", F.lit(1.0)), pool.limit(1).withColumn("s", F.lit(1.0)), "s").collect()


def test_schedule_and_catalogue(spark):
    rates = [r[0] for r in spark.range(0, 12).select(sft.lr_schedule(F.col("id"), 1.0, 2, 10, 0.1)).collect()]
    assert rates[0] == 0.5 and rates[1] == 1.0 and abs(rates[6] - (0.1 + 0.9 * 0.5)) < 1e-12 and rates[11] == 0.1
    assert len(experiments.JOBS) == 32 and len(experiments.select(["binary_*"])) == 3 and len(experiments.source_pairs()) == 21
    with pytest.raises(ValueError):
        experiments.select(["nothing*"])


def test_token_loss_counts_long_records(spark, tmp_path):
    from turnloom.plans import catalogue

    conv = lambda n: [("user", " ".join(["word"] * n)), ("assistant", "reply")]
    rows = [("s", conv(n)) for n in (0, 1, 60, 61, 4096, 4097)]
    spark.createDataFrame(rows, "source string, conversation array<struct<role:string,content:string>>").write.parquet(f"{tmp_path}/interim_record.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["token_loss"](spark, str(tmp_path)).collect()] == [("s", 0.4, 1.491825, 4, 4218)]


def test_noise_floor_equals_brute_force(spark):
    import hashlib
    import statistics

    rng = random.Random(5)
    rows = [(f"c{i}", rng.choice(["g", "g", "h", None]), rng.random() < 0.8, [rng.randint(0, 1) for _ in range(3)]) for i in range(203)]
    got = dict(map(tuple, X.noise_floor(spark.createDataFrame(rows, "id string, g string, complete boolean, vector array<int>"), ["g"], "id", 25, "7").collect()))
    for g in ("g", "h"):
        draws = []
        for rep in range(25):
            order = sorted((r for r in rows if r[1] == g), key=lambda r: hashlib.md5(f"7:{rep}:{r[0]}".encode()).hexdigest())
            h = len(order) // 2
            shares = [[statistics.fmean(col) for col in zip(*(r[3] for r in part if r[2]))] for part in (order[:h], order[h : 2 * h])]
            draws.append(100 * statistics.fmean(abs(a - b) for a, b in zip(*shares)))
        assert abs(got[g] - statistics.median(draws)) < 1e-9
    assert set(got) == {"g", "h"}


def test_noise_floor_draws_as_often_as_the_reference(spark, small_dir, monkeypatch):
    from turnloom.plans import catalogue

    asked, real = [], X.noise_floor
    monkeypatch.setattr(X, "noise_floor", lambda *args: asked.append(args[3]) or real(*args))
    assert catalogue.QUERIES["noise_floor"](spark, small_dir).count() and asked == [1000]
