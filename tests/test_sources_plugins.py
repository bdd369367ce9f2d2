import csv
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom import plugins
from turnloom.operators.taxonomy import latest
from turnloom.sources import readers as R
from turnloom.sources import sinks
from turnloom.streaming import log as stream_log

MSG = "array<struct<role:string,content:string>>"


def test_parquet_releases(spark, tmp_path):
    conv = [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]
    rows = [("h1", "ip", "US", "m", None, "English", conv, False, False, 1, 5), ("h2", "", None, "m", None, "English", conv, False, False, 1, 5), ("h3", "ip", "", "m", None, "x", conv, False, False, 1, 5)]
    schema = f"conversation_hash string, hashed_ip string, country string, model string, timestamp timestamp, language string, conversation {MSG}, redacted boolean, toxic boolean, turn int, extra int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "w"))
    got = R.LOADERS["wildchat_1m"](spark, str(tmp_path / "w")).orderBy("conv_id").collect()
    assert [r["group_id"] for r in got] == ["ip_US", "wildchat_1m:h2", "ip_unknown"] and got[0]["conversation"][1]["content"] == ""
    plan = R.LOADERS["wildchat_1m"](spark, str(tmp_path / "w"))._jdf.queryExecution().executedPlan().toString()
    assert "extra" not in plan


def test_json_and_pairs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "x", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"id": "y"}]))
    got = {r["conv_id"]: r for r in R.sharegpt(spark, str(tmp_path / "s.json")).collect()}
    assert [t["role"] for t in got["x"]["conversation"]] == ["user", "assistant"] and got["y"]["conversation"] == []
    for split in ("train", "test"):
        (tmp_path / "hh" / "base").mkdir(parents=True, exist_ok=True)
        with gzip.open(tmp_path / "hh" / "base" / f"{split}.jsonl.gz", "wt") as f:
            for i in range(3):
                f.write(json.dumps({"chosen": f"\n\nHuman: q{i}\n\nAssistant: yes", "rejected": f"\n\nHuman: q{i}\n\nAssistant: no"}) + "\n")
    got = {r["conv_id"]: r for r in R.hh_rlhf(spark, str(tmp_path / "hh")).collect()}
    assert set(got) == {f"base/{s}/{i}" for s in ("train", "test") for i in range(3)}
    (tmp_path / "plain" / "b").mkdir(parents=True)
    (tmp_path / "plain" / "b" / "train.jsonl").write_text("".join(json.dumps({"chosen": f"\n\nHuman: q{i}\n\nAssistant: yes", "rejected": f"\n\nHuman: q{i}\n\nAssistant: no"}) + "\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = R.hh_rlhf(spark, str(tmp_path / "plain")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["conv_id"]: r["conversation"][0]["content"] for r in rows} == {f"b/train/{i}": f"q{i}" for i in range(400)}
    assert got["base/test/2"]["presplit"] == "test" and [t["content"] for t in got["base/test/2"]["conversation"]] == ["q2", "yes"]


def test_turn_csv(spark, tmp_path):
    cols = ["url", "message_index", "role", "plain_text", "model", "detected_language_final", "created_at", "create_time", "message_create_time", "published_at"]
    rows = [["u", "1", "LLM", 'said "hi",\nthen left', "m", "", "", "", "", ""], ["u", "0", "Human", "q", "", "en", "", "7", "", ""], ["", "0", "user", "lost", "", "en", "", "", "", ""], ["v", "0", "user", "q", "", "de", "", "", "", ""], ["v", "0", "user", "r", "", "fr", "", "", "", ""]]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerows([cols, *rows])
    got = {r["conv_id"]: r for r in R.sharechat(spark, str(tmp_path / "t.csv"), "p").collect()}
    assert set(got) == {"u", "v"} and got["u"]["model"] == "p:m" and got["u"]["lang_label"] == "English" and got["u"]["timestamp"] == "7"
    assert [t["content"] for t in got["u"]["conversation"]] == ["q", 'said "hi",\nthen left'] and got["v"]["lang_label"] is None
    assert json.loads(got["v"]["meta"])["user_language_labels"] == ["de", "fr"]
    df = spark.createDataFrame([("u", None), ("u", None), ("w", "0"), ("w", "00"), ("", "0"), ("", "0")], "url string, message_index string")
    assert [r[0] for r in R.ambiguous_urls(df).collect()] == ["u"]


def test_sessions(spark, tmp_path):
    block = lambda t, kind="text": [{"type": kind, "text": t, "image": None}]
    turn = lambda u, a, kind="text": {"user": {"role": "user", "content": block(u, kind)}, "model_side_a": {"role": "assistant", "content": block(a)}, "model_side_b": {"role": "assistant", "content": block("b")}}
    msg = "struct<role:string,content:array<struct<type:string,text:string,image:string>>>"
    schema = f"id string, evaluation_session_id string, evaluation_order int, timestamp timestamp, language string, winner string, model_a string, model_b string, full_conversation array<struct<user:{msg},model_side_a:{msg},model_side_b:{msg}>>"
    rows = [("1", "s", 1, None, "en", "a", "x", "y", [turn("q", "r")]), ("2", "s", 2, None, "en", "a", "x", "y", [turn("q", "r"), turn("q2", "r2")]), ("3", "t", 1, None, "de", "a", "x", "y", [turn("q", "r")]), ("4", "w", 1, None, "en", "a", "x", "y", [turn(" ", "r")]), ("5", "z", 1, None, "en", "a", "x", "y", [turn("q", "r", "image")]), ("6", "n", 1, None, "en", "a", "x", "y", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a"))
    got = R.arena(spark, str(tmp_path / "a")).collect()
    assert [(r["conv_id"], len(r["conversation"])) for r in got] == [("2", 4)]


def test_sinks_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("s", "train", 1), ("s", "test", 2)], "source string, split string, x int")
    sinks.write_corpus(df, str(tmp_path / "c"))
    assert sinks.exists(df, str(tmp_path / "c")) and (tmp_path / "c" / "source=s" / "split=test").is_dir()
    with pytest.raises(Exception):
        sinks.write_corpus(df, str(tmp_path / "c"))
    assert json.loads(sinks.manifest(df.select("source", F.col("split").alias("stage"), F.col("x").alias("n")))) == {"s": {"test": 2, "train": 1}}
    log = spark.createDataFrame([("k", 1, "a")], "key string, seq bigint, status string")
    sinks.append_log(log, str(tmp_path / "log"))
    sinks.append_log(log.withColumn("seq", F.lit(2)).withColumn("status", F.lit("b")), str(tmp_path / "log"))
    read = R.jsonl(spark, str(tmp_path / "log"), "key string, seq bigint, status string")
    assert latest(read, ["key"]).first()["status"] == "b" and R.jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    q = stream_log.keep_latest(stream_log.log_stream(spark, str(tmp_path / "log"), "key string, seq bigint, status string", 1), str(tmp_path / "out"), ["key"], str(tmp_path / "cp"))
    q.awaitTermination(60)
    kept = stream_log.read_latest(spark, str(tmp_path / "out"), "key string, seq bigint, status string").collect()
    assert [(r["key"], r["seq"], r["status"]) for r in kept] == [("k", 2, "b")]


def test_task_pool(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text(json.dumps({"question": " q ", "answer": "x #### 1,5"}) + "\n\n")
    assert [tuple(r) for r in R.task_pool(spark, str(tmp_path / "g.jsonl"), "gsm8k").collect()] == [("gsm8k/0", "gsm8k", "q", '{"answer":"15","solution":"x #### 1,5"}')]


def test_plugins(spark):
    df = spark.createDataFrame([("hola",), ("",), (None,)], "t string")
    lang = plugins.language_id(lambda: lambda texts: [("es", 0.9) for _ in texts])
    assert [tuple(r[0]) for r in df.select(lang(F.col("t"))).collect()] == [("es", 0.9), (None, 0.0), (None, 0.0)]
    assert [r[0] for r in df.select(plugins.tokenizer(lambda: lambda ts: [[len(t)] for t in ts])(F.col("t"))).collect()] == [[4], [0], [0]]
    out = plugins.generate_column(df, lambda: lambda p: (p or "x").upper(), "t", "o")
    assert [r["o"] for r in out.collect()] == ["HOLA", "X", "X"]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "v array<array<float>>").select(plugins.pooled(F.col("v"), "mean"), plugins.pooled(F.col("v"), "last"), plugins.pooled(F.col("v"), "mean_normalized")).first()
    assert v[0] == [2.0, 4.0] and v[1] == [3.0, 6.0] and abs(sum(x * x for x in v[2]) - 1) < 1e-9
    with pytest.raises(Exception, match="non-finite"):
        df.select(plugins.encoder(lambda: lambda ts: [[float("nan")] for _ in ts])(F.col("t"))).collect()


def test_generation_policies():
    waits = []
    calls = iter([ValueError(), ValueError(), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert plugins.with_retries(call, 4, waits.append, random.Random(0)) == "ok" and len(waits) == 2

    def refuse():
        raise plugins.GiveUp

    assert plugins.with_retries(refuse, 4, waits.append) is None and len(waits) == 2
