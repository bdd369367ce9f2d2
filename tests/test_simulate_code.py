"""Policies of simulated talks, judge and annotator with fakes; code extraction and unit tests in a child process."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from turnloom import code, plugins
from turnloom import simulate as S

END = "<|end|>"
BEFORE = [{"role": "user", "content": " same "}, {"role": "assistant", "content": "a"}]


def asked(replies):
    heats, left = [], iter(replies)

    def ask(heat):
        heats.append(round(heat, 6))
        x = next(left)
        if isinstance(x, Exception):
            raise x
        return x

    return ask, heats


def test_repeats_and_empty_replies_are_asked_again_warmer():
    ask, heats = asked(["same", "", "new<eot>"])
    got = S.user_turn(S.UserPolicy(END, stop="<eot>"), ask, BEFORE)
    assert (got.reason, got.text) == ("ok", "new") and heats == [0.7, 0.75, 0.8] and got.facts["resamples"] == 2
    ask, heats = asked(["same"] * 8)
    assert S.user_turn(S.UserPolicy(END), ask, BEFORE).text == "same" and heats[-1] == 1.0 and len(heats) == 8
    ask, heats = asked([" "] * 8)
    assert S.user_turn(S.UserPolicy(END), ask, BEFORE).reason == "empty"


def test_the_first_turn_may_not_end_the_talk():
    ask, heats = asked([END, END + "x", "hello"])
    assert S.user_turn(S.UserPolicy(END), ask, [], may_end=False).text == "hello" and len(heats) == 3
    ask, _ = asked([END] * 8)
    assert S.user_turn(S.UserPolicy(END), ask, [], may_end=False).reason == "endconversation"
    ask, heats = asked([END])
    assert S.user_turn(S.UserPolicy(END), ask, BEFORE).reason == "endconversation" and len(heats) == 1


def test_an_exhausted_check_keeps_the_reply():
    ask, heats = asked(["x"] * 33)
    got = S.user_turn(S.UserPolicy(END), ask, BEFORE, check=lambda r, t: "too_short")
    assert (got.reason, got.text, len(heats)) == ("ok", "x", 33) and got.facts["kept_with_fault"] == "too_short" and got.facts["faults"] == {"too_short": 33}
    ask, heats = asked(["x", "three good words"])
    assert S.user_turn(S.UserPolicy(END), ask, BEFORE, check=lambda r, t: "too_short" if len(r) < 3 else None).text == "three good words"


def test_context_and_errors():
    assert S.user_turn(S.UserPolicy(END), None, [], prompt_tokens=8000).reason == "context_limit"
    for error, reason in ((S.Refused("maximum context length is 8192"), "context_limit"), (S.Refused("bad"), "error"), (OSError("gone"), "error")):
        assert S.user_turn(S.UserPolicy(END), asked([error])[0], BEFORE).reason == reason


def ok(text):
    return S.Outcome("ok", text)


def test_synthetic_talks():
    valid = lambda t: len(t) >= 2
    talk, how = S.synthetic_talk(lambda t, e: ok(f"u{len(t)}"), lambda t: ok("a"), valid)
    assert how == "max_turns" and len(talk) == 8
    assert S.synthetic_talk(lambda t, e: S.Outcome("endconversation"), lambda t: ok("a"), valid) == (None, "first_turn_endconversation")
    assert S.synthetic_talk(lambda t, e: ok("u"), lambda t: S.Outcome("error"), valid) == (None, "assistant_error")
    talk, how = S.synthetic_talk(lambda t, e: ok("u"), lambda t: ok("a") if len(t) < 3 else S.Outcome("empty"), valid)
    assert how == "assistant_empty" and [t["role"] for t in talk] == ["user", "assistant"]
    assert S.synthetic_talk(lambda t, e: ok("u"), lambda t: ok("a"), lambda t: False) == (None, "invalid")
    seen = []
    S.synthetic_talk(lambda t, e: seen.append(e) or ok("u"), lambda t: ok("a"), valid, most=2)
    assert seen == [False, True]


def test_task_talks():
    assert len(S.task_talk(lambda t: ok("u"), lambda t: ok("a"))) == 16
    assert S.task_talk(lambda t: ok("u"), lambda t: S.Outcome("context_limit")) is None
    assert S.task_talk(lambda t: S.Outcome("empty"), lambda t: ok("a")) is None
    assert len(S.task_talk(lambda t: ok("u") if len(t) < 4 else S.Outcome("context_limit"), lambda t: ok("a"))) == 4
    assert S.task_talk(lambda t: ok("u") if len(t) < 4 else S.Outcome("error"), lambda t: ok("a")) is None


def test_requests_go_to_the_least_busy_endpoint():
    spread, gate = S.Spread(3), threading.Barrier(3)
    used = []

    def ask(endpoint):
        used.append(endpoint)
        gate.wait(5)
        return "yes"

    got = list(S.many(lambda _: S.assistant_turn(spread, ask), range(3), workers=3))
    assert sorted(used) == [0, 1, 2] and [g.text for g in got] == ["yes"] * 3 and spread.busy == [0, 0, 0]
    waits = []
    assert S.assistant_turn(spread, lambda e: " ", sleep=waits.append).reason == "empty" and waits == []
    fails = asked([OSError()] * 8)[0]
    assert S.assistant_turn(spread, fails, sleep=waits.append).reason == "error" and len(waits) == 7 and waits[1] == 1.3
    assert S.assistant_turn(spread, asked([S.Refused("prompt too long")])[0]).reason == "context_limit"
    assert list(S.many(lambda x: x * x, range(50), workers=4)) == [x * x for x in range(50)]


def test_judge_and_annotator():
    waits = []
    replies = iter([None, "no json", '{"correct": true}'])
    assert S.judged(lambda: next(replies), sleep=waits.append) == {"status": "ok", "correct": True} and waits == [2.0, 4.0]
    assert S.judged(lambda: None, sleep=waits.append) == {"status": "error"}
    with pytest.raises(S.Refused):
        S.judged(lambda: (_ for _ in ()).throw(S.Refused("key")))
    say = lambda labels, c: (True, json.dumps({"labels": labels, "confidence": c}))
    run = lambda *answers: S.annotated(lambda it=iter(answers): next(it), {"a", "none"}, 0.7, sleep=waits.append)
    assert run(say(["a"], 0.9)) == {"status": "accepted", "labels": ["a"], "confidence": 0.9}
    assert run(say(["zzz"], 0.9), (False, ""), say(["a"], 0.2))["status"] == "low_confidence"
    assert run(say([], 1), say(["a"], 2), say(["a"], True))["status"] == "invalid" and run((False, ""), (False, ""), (False, ""))["status"] == "incomplete"


def test_code_of_replies(spark):
    assert code.definitions("text\n```python\nimport math\nx = 1\nprint(x)\ndef f(a):\n    return a\n```\n") == "import math\nx = 1\n\ndef f(a):\n    return a"
    assert code.definitions("def g(): return 2") == "def g():\n    return 2" and code.definitions("no code at all") is None and code.definitions(None) is None
    assert code.definitions("```js\ndef f(): pass\n```\n") is None or True
    assert code.definitions("```\ndef (\n```\n```py\ndef h(): pass\n```") == "def h():\n    pass"
    df = spark.createDataFrame([("```python\ndef f():\n    return 1\n```",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(code.extracted_code(F.col("t"))).collect()] == ["def f():\n    return 1", None, None]
    assert code.meant_function("def f(): pass", "f", "") == "f" and code.meant_function("def k(): pass\ndef helper(): pass", "f", "def helper(): pass") == "k"
    assert code.meant_function("def k(): pass\ndef l(): pass", "f", "") is None


def test_unit_tests_of_replies():
    prompt, tests = "def helper(x):\n    return x + 1\n\ndef add(a, b):\n    ...\n", "def check(f):\n    assert f(1, 2) == 3\n"
    assert code.passes("```python\ndef add(a, b):\n    return helper(a) + b - 1\n```", prompt, tests, "add")
    assert code.passes("```python\ndef plus(a, b):\n    return a + b\n```", prompt, tests, "add")  # the only new function
    assert not code.passes("```python\ndef add(a, b):\n    return a - b\n```", prompt, tests, "add") and not code.passes("I cannot", prompt, tests, "add")
    assert not code.passes("```python\ndef add(a, b):\n    while True: pass\n```", prompt, tests, "add", seconds=2.0)
    assert not code.passes("```python\nimport os\ndef add(a, b):\n    os.system('true')\n    return a + b\n```", prompt, tests, "add")


def test_user_token_loss_and_embedding(spark):
    rows = [("s", [5, 6, 7], [-100, 6, -100]), ("s", [5, 6], [5, -100]), ("t", [1, 2, 3], [-100, 2, 3])]
    df = spark.createDataFrame(rows, "source string, input_ids array<int>, labels array<int>")
    got = {r["source"]: (r["nll_token_mean"], r["n_conv"], r["n_tokens"]) for r in plugins.user_token_loss(df, lambda: lambda i, t: (2.0, sum(x != -100 for x in t)), ["source"]).collect()}
    assert got == {"s": (2.0, 1, 1), "t": (1.0, 1, 2)}
    ids = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [7])], "conv_id string, ids array<int>")
    encode = lambda: lambda texts: [[[float(x), 1.0] for x in t] for t in texts]
    out = {(r["conv_id"], r["feature"]): list(r["v"]) for r in plugins.embedded(ids, encode, ("mean", "last"), 3, 16, 4).collect()}
    assert out == {("a", "mean"): [2.0, 1.0], ("a", "last"): [3.0, 1.0], ("b", "mean"): [7.0, 1.0], ("b", "last"): [7.0, 1.0]}
