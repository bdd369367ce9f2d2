"""Drivers of the experiments, guards and small readers on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import conversation as C
from turnloom.operators import joins as J
from turnloom.operators import sft, tasks
from turnloom.plans import experiments as E
from turnloom.sources import readers, sinks


def test_names():
    assert E.model_tag("Qwen/Qwen2.5-7B-Instruct") == "Qwen--Qwen2.5-7B-Instruct" and E.assistant_tag("Qwen/Qwen2.5-14B-Instruct") == "qwen2p5-14b-instruct"
    assert E.synthetic_name("lmsys", "sharegpt", "x") == "synth_lmsys--user_sharegpt_llama3--assistant_x" and E.user_family("Qwen/Q") == "qwen2.5"
    assert sum(j.startswith("qwen_") for j in E.JOBS) == 4 and E.JOBS["focal_original"].markers


def test_drivers():
    calls = []
    rows = E.fingerprint_pairs(lambda train, ev: calls.append((train, ev)) or (0.9, 0.7 if ev else None), "x")
    assert len(rows) == 10 and rows[0]["real_to_synth"] == 0.7 and len(calls) == 20
    grid = E.assistant_comparisons(lambda sets, view, turns: float(len(sets)))
    assert len(grid) == 4 * 4 * 17 and grid[-1]["chance"] == 1 / 3 and grid[-1]["score"] == 3.0


def test_matching_and_probe(spark):
    rng = random.Random(1)
    row = lambda i: (f"c{i}", [rng.randint(0, 1)], rng.random() < 0.9, [rng.randint(0, 1)], True, [1], True, [rng.randint(1, 3)])
    schema = "conv_id string, function array<int>, function_complete boolean, topic array<int>, topic_complete boolean, multiturn array<int>, multiturn_complete boolean, structure array<int>"
    frames = {s: spark.createDataFrame([row(i) for i in range(k, k + 40)], schema) for k, s in ((0, "p"), (100, "q"))}
    seen = []
    out = E.forward_matching(lambda s, split: frames[s], lambda pair, rows: seen.append(rows) or 0.5, ("p", "q"))
    assert len(out) == 5 and out[0]["condition"] == () and all(o["sizes"]["train"] > 0 for o in out[1:])
    kept = {r["conv_id"] for r in seen[2].where("split = 'train'").collect()}
    total = lambda df: df.where(F.col("conv_id").isin(*kept)).agg(F.sum(F.col("function")[0]), F.sum(F.col("topic")[0]), F.count("*")).first()
    assert tuple(total(frames["p"])) == tuple(total(frames["q"]))
    with pytest.raises(ValueError, match="no complete"):
        E.matched_rows(frames["p"].withColumn("topic_complete", F.lit(False)), frames["q"], E.FACETS[:2], "1")
    rows = [("f", split, k % 2, [float(k % 2) + rng.random() * 0.1, rng.random()]) for split in ("train", "val", "test") for k in range(40)]
    got = E.run_probe(spark.createDataFrame(rows, "feature string, split string, label int, v array<double>"), 2)
    assert got["test"]["accuracy"] == 1.0 and got["feature"] == "f"
    assert [r["label"] for r in E.one_against_rest(spark.createDataFrame([("a",), ("b",)], "source string"), "b").orderBy("source").collect()] == [0, 1]


def test_guards(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(J.BrokenRule, match="no thing"):
        J.total_join(a, a.where("k = 1").withColumnRenamed("v", "w"), "k", "thing")
    with pytest.raises(Exception, match="no thing"):
        J.total_join(a, a.where("k = 1").withColumnRenamed("v", "w"), "k", "thing", checked=False).collect()
    assert J.total_join(a, a.withColumnRenamed("v", "w"), "k", "thing").count() == 2
    log = spark.createDataFrame([("c", "old", 1), ("c", "new", 2), ("d", "x", 3)], "conv_id string, intent string, seq bigint")
    assert [r["intent"] for r in J.with_last_intent(spark.createDataFrame([("c",), ("e",)], "conv_id string"), log).collect()] == ["new"]
    seeds = spark.createDataFrame([("p", "train", "1"), ("q", "train", "1"), ("p", "val", "2"), ("q", "train", "3"), ("q", "val", "1"), ("p", "val", "1")], "source string, split string, seed_conv_id string")
    assert {tuple(r) for r in J.unpaired_intents(seeds, ["p", "q"]).collect()} == {("2", "lacking"), ("3", "lacking"), ("1", "crossing")}
    assert J.unpaired_intents(seeds.union(spark.createDataFrame([("p", "val", None)], seeds.schema)), ["p", "q"]).count() == 0
    assert J.shared_features([["b", "a"], ["a", "c"]]) == ["a"]
    with pytest.raises(J.BrokenRule):
        J.shared_features([["a"], ["b"]])
    assert J.expected_counts({"lmsys": 9, "sharegpt": 50}, {"train": 40, "val": 3, "test": 7})[("sharegpt", "val")] == 3
    assert J.unstable_prefixes(a, F.col("v"), F.concat("v", F.lit("z")), "k").count() == 0 and J.unstable_prefixes(a, F.lit("q"), F.col("v"), "k").count() == 2
    assert len(J.union_all([a, a.drop("v")]).columns) == 2


def test_small_readers(spark, tmp_path):
    lines = [json.dumps({"question": f" q{i} ", "answer": f"so\n#### 1,{i:03d}"}) for i in range(5)]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    got = {r["task_id"]: (r["problem"], json.loads(r["gold"])) for r in readers.task_pool(spark, str(tmp_path / "g.jsonl"), "gsm8k").collect()}
    assert got["gsm8k/3"] == ("q3", {"answer": "1003", "solution": "so\n#### 1,003"}) and len(got) == 5
    prior = spark.createDataFrame([("sharded-GSM8K/12",), ("sharded-HumanEval/3",), ("sharded-GSM8K/12",), ("other/1",)], "task_id string")
    assert {r[0] for r in readers.prior_task_ids(prior).collect()} == {"gsm8k/12", "HumanEval/3"}
    (tmp_path / "s.jsonl").write_text('{"input_ids": [1, 2], "labels": [-100, 2]}\n{"input_ids": [1, 2], "labels": [1, -100]}\n{"input_ids": [1, 2, 3], "labels": [-100, 2, 3]}')
    assert [list(r["attention_mask"]) for r in readers.samples(spark, str(tmp_path / "s.jsonl"), 2).collect()] == [[1, 1]]
    df = spark.createDataFrame([(1, "English"), (2, "German")], "i int, lang_label string").withColumn("conversation", F.array(F.struct(F.lit("user").alias("role"), F.col("lang_label").alias("content"))))
    fake = lambda text: F.struct(F.when(text == "German", "en").otherwise("de").alias("lang"))
    assert [r["i"] for r in readers.english_rows(df, True).collect()] == [1] and [r["i"] for r in readers.english_rows(df, False, fake).collect()] == [2]


def test_sinks_and_small_operators(spark, tmp_path):
    df = spark.range(200).select("id", F.lit("s").alias("source"), F.lit("train").alias("split"))
    assert sinks.write_corpus(df, str(tmp_path / "c"), "parquet", "id", files=2) == 200
    order = [r["id"] for r in spark.read.parquet(str(tmp_path / "c")).collect()]
    assert sorted(order) == list(range(200)) and order != list(range(200))
    ids = spark.createDataFrame([([1, 2], [-100, 2])], "i array<int>, l array<int>")
    assert [list(x) for x in ids.select(sft.padded_sample(F.col("i"), F.col("l"), 3).alias("p")).first()["p"]] == [[1, 2, 0], [1, 1, 0], [-100, 2, -100]]
    with pytest.raises(Exception, match="longer than the bucket"):
        ids.select(sft.padded_sample(F.col("i"), F.col("l"), 1)).collect()
    pool = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "task_id string, at int")
    assert [r["task_id"] for r in tasks.in_pool_order(pool.select("task_id").where("task_id != 'a'"), pool, "at").collect()] == ["b", "c"]
    corpus = spark.createDataFrame([("s", "c1", [("user", "Hi"), ("assistant", "x")], 1, '{"seed_conv_id": "z"}'), ("t", "c2", [("user", "Yo")], 1, "{}")],
                                   "source string, conv_id string, conversation array<struct<role:string,content:string>>, n_words_user int, meta string")
    got = {r["conv_id"]: (r["text"], r["label"], r["n_user_turns"], r["seed_conv_id"]) for r in C.view_rows(corpus, ["t", "s"]).collect()}
    assert got == {"c1": ("User: Hi\nAssistant: <assistant_response>", 1, 1, "z"), "c2": ("User: Yo", 0, 1, None)}
