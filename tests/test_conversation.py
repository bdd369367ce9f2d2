from pyspark.sql import functions as F

from turnloom.operators import conversation as C
from turnloom.operators import prompts as P

CONV = "array<struct<role:string,content:string>>"


def frame(spark, convs):
    rows = [(i, None if c is None else [{"role": r, "content": t} for r, t in c]) for i, c in enumerate(convs)]
    return spark.createDataFrame(rows, f"i int, conv {CONV}").orderBy("i")


def test_rejection_reasons(spark):
    u, a = ("user", "x"), ("assistant", "y")
    cases = [
        (None, "too_short"), ([], "too_short"), ([u], "too_short"), ([("system", "s"), u], "not_user_first"), ([u, u], "not_alternating"),
        ([u, a, a], "not_alternating"), ([u, ("assistant", " 　")], "empty_turn"), ([u, ("assistant", None)], "empty_turn"),
        ([u, a, u], None), ([u, a], None), ([(None, "x"), a], "not_user_first"), ([u, (None, "y")], "not_alternating"),
    ]
    got = frame(spark, [c for c, _ in cases]).select(C.rejection_reason(F.col("conv")).alias("r")).collect()
    assert [r["r"] for r in got] == [e for _, e in cases]


def test_views_metadata_and_padding(spark):
    conv = [("user", "Hi There"), ("assistant", "Yo"), ("user", "b b")]
    df = frame(spark, [conv, [], None])
    c = F.col("conv")
    r = df.select(
        C.serialize(c).alias("m"), C.serialize(c, "full_unmasked", True).alias("l"), C.serialize(c, "first_turn").alias("f"),
        C.serialize(c, "user_masked", True).alias("u"), F.size(C.pad_unanswered(c)).alias("p"), C.count_features(c, True).alias("n")).collect()
    assert r[0]["m"] == "User: Hi There\nAssistant: <assistant_response>\nUser: b b"
    assert r[0]["l"] == "User: hi there\nAssistant: Yo\nUser: b b"
    assert r[0]["f"] == "User: Hi There" and r[0]["u"] == "User: <user_query>\nAssistant: Yo\nUser: <user_query>"
    assert r[0]["p"] == 4 and r[0]["n"] == [2, 1, 4] and r[1]["m"] == ""
    meta = C.with_metadata(df, "conv").collect()
    assert [m["n_turns"] for m in meta] == [3, 0, 0] and meta[0]["n_words_user"] == 4
    assert meta[1]["user_text_hash"] == meta[2]["user_text_hash"]


def test_markers_in_user_turns_only(spark):
    df = frame(spark, [[("user", "go <URL> on"), ("assistant", "<URL>")]])
    r = df.select(C.clean_conversation(F.col("conv")).alias("c"), C.has_marker(F.col("conv")).alias("h")).first()
    assert [t["content"] for t in r["c"]] == ["go on", "<URL>"] and r["h"]


def test_roles_and_transcripts(spark):
    df = frame(spark, [[("human", "a"), ("gpt", None), ("tool", "c"), (None, "d")]])
    conv = C.normalise_roles(F.col("conv"), "role", "content", ("human",), ("gpt",))
    got = df.select(conv.alias("c")).first()["c"]
    assert [(t["role"], t["content"]) for t in got] == [("user", "a"), ("assistant", ""), ("unknown:tool", "c"), ("unknown:None", "d")]
    pair = spark.createDataFrame([("\n\nHuman: q\n\nAssistant: yes\n\nHuman: no turn", "\n\nHuman: q\n\nAssistant: yet")], "a string, b string")
    got = pair.select(P.parse_preference_pair(F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert [(t["role"], t["content"]) for t in got] == [("user", "q"), ("assistant", "yes\n\nHuman: no turn")]
    bad = spark.createDataFrame([("x", "y")], "a string, b string").select(P.parse_preference_pair(F.col("a"), F.col("b")))
    try:
        bad.collect()
        raise SystemExit("no error")
    except Exception as e:
        assert "before any assistant turn" in str(e)
    got = spark.createDataFrame([("",), ("plain",), ("\n\nHuman: a ",)], "t string").select(P.parse_transcript(F.col("t")).alias("c")).collect()
    assert [len(r["c"]) for r in got] == [0, 0, 1] and got[2]["c"][0]["content"] == "a"


def test_prompts(spark):
    df = frame(spark, [[("user", " a "), ("assistant", "b")]])
    c = F.col("conv")
    r = df.select(P.render_chat(c, "llama").alias("l"), P.render_chat(c, "qwen", False).alias("q"), P.intent_prompt(c, [("h", "i")], "Do it.").alias("p")).first()
    assert r["l"].startswith("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\na<|eot_id|>") and r["l"].endswith("user<|end_header_id|>\n\n")
    assert r["q"].startswith("<|im_start|>system\nYou are Qwen") and r["q"].endswith("b<|im_end|>\n")
    assert r["p"].startswith("Do it.\n\nExample 1:") and "<user>:  a \n<assistant>: b" in r["p"]
    assert r["p"].endswith("following conversation:\n\n<user>:  a \n<assistant>: b\n\nReply with only the intent summary and nothing else.")
    j = df.select(P.judge_prompt(F.lit("p"), F.lit("s"), F.lit("4"), F.lit("r")).alias("j")).first()["j"]
    assert j == "## Original problem\np\n\n## Reference solution\ns\n\n## Reference answer\n4\n\n## Assistant response\nr"
