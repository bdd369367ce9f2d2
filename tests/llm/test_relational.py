"""Problems 2 to 6 against brute force on small fixtures, with nulls, ties, empty tables and clashing columns."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from turnloom.llm import copies, group_splits, match_groups, rebuild, repeated_lines

CONV = "array<struct<role:string,content:string>>"
REC = f"rec_id bigint, source string, conv_id string, group_id string, model string, presplit string, conversation {CONV}, meta string, first_turn_hash string, user_text_hash string"
CLASH = {"id": 1, "key": "k", "kind": "x", "n": 2, "u": 3, "v": 4, "component": "c", "node": 5, "h": 6, "bucket": 7, "line": "l", "lines": "m", "error": 0, "copies": 1, "rep": 2, "split": "s", "rank": 9, "version": "v1", "op": "o"}


def talk(*texts):
    return [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)]


def clash(df, keep=()):
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns and k not in keep})


def closure(rows, keys):
    """Union by shared keys, the plain way: {id: set of ids}."""
    parent = {r: r for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owner = {}
    for r in rows:
        for k in keys(rows[r]):
            if k in owner:
                parent[find(r)] = find(owner[k])
            owner.setdefault(k, r)
    groups = {}
    for r in rows:
        groups.setdefault(find(r), set()).add(r)
    return {r: g for g in groups.values() for r in g}


def records(seed, n=160, hot=0.35):
    rng = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        opener = rng.choice(["one two three four five", "short", "a b c d e f", ""])
        hot_row = rng.random() < hot
        out.append((i, rng.choice(["s", "t", None]), f"c{rng.randrange(n)}" if rng.random() < 0.9 else None, "hot" if hot_row else rng.choice([f"g{rng.randrange(n)}", None]),
                    rng.choice(["m", "w", None]), rng.choice([None, None, "train", " TRAIN ", "test", "val"]), None if rng.random() < 0.05 else talk(opener, "reply"), "{}",
                    rng.choice([None, f"f{rng.randrange(20)}"]), rng.choice([None, f"u{rng.randrange(60)}"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_match_groups(spark, seed):
    rows = records(seed)
    got = {r["rec_id"]: r["component"] for r in match_groups.match_groups(clash(spark.createDataFrame(rows, REC))).collect()}

    def keys(r):
        opener = r[6][0]["content"] if r[6] else ""
        return [("g", r[3])] * (r[3] is not None) + [("u", r[9])] * (r[9] is not None) + [("f", r[8])] * (r[8] is not None and len(opener.split()) >= 5)

    sets = closure({r[0]: r for r in rows}, keys)
    expect = {i: min((rows[j - 1][3] for j in s if rows[j - 1][3] is not None), default=None) for i, s in sets.items() if len(s) > 1}
    assert got == expect


@pytest.mark.parametrize("seed", [3, 4])
def test_splits(spark, seed):
    rows = records(seed)
    df = clash(spark.createDataFrame(rows, REC), keep=("split",))
    sets = closure({r[0]: r for r in rows}, lambda r: [("g", r[3])] * (r[3] is not None) + [("c", r[2])] * (r[2] is not None))
    given = {i: {rows[j - 1][5].strip().lower() for j in s if rows[j - 1][5] is not None} for i, s in sets.items()}
    assert {r[0] for r in group_splits.contradicting_rows(df).collect()} == {i for i in sets if len(given[i]) > 1}
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.06), ("test", 0.14)], "split string, share double")
    got = {r["rec_id"]: r["split"] for r in group_splits.assign_splits(df, targets).collect()}
    assert set(got) == set(sets)
    for i, s in sets.items():
        assert len({got[j] for j in s}) == 1
        if len(given[i]) == 1:
            assert got[i] == next(iter(given[i]))
    with pytest.raises(ValueError):
        group_splits.assign_splits(df, targets.limit(0))


def test_forest_and_greedy():
    rng = random.Random(0)
    import numpy as np

    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    u, v = group_splits.forest(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    sets = closure({i: i for i in range(300)}, lambda i: [frozenset(e) for e in edges if i in e])
    assert dict(zip(u.tolist(), v.tolist())) == {i: min(s) for i, s in sets.items() if min(s) != i}
    for size, count, start in ((1, 57, [30.0, 10.0, 5.0]), (7, 9, [-3.0, 40.0, 2.5]), (3, 0, [1.0, 1.0])):
        left, plain = list(start), [0] * len(start)
        for _ in range(count):
            i = max(range(len(left)), key=lambda k: (left[k], -k))
            plain[i] += 1
            left[i] -= size
        assert sum(group_splits.greedy_counts(size, count, list(start))) == count
        assert sorted(d - size * g for d, g in zip(start, group_splits.greedy_counts(size, count, list(start)))) == pytest.approx(sorted(left))


def test_forest_stops_at_its_bound(spark, monkeypatch):
    from turnloom.staging import Stage

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 600, 1)] + [(2000, 2001)], "u bigint, v bigint")
    monkeypatch.setattr(group_splits, "TASK_EDGES", 50)
    got = {r["node"]: r["component"] for r in group_splits.merged_forest(Stage(spark, "t"), edges.repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(601)}, 2000: 2000, 2001: 2000}


def test_repeated_lines(spark):
    rng = random.Random(7)
    bank = [f"this line number {w} is printed again" for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    rows = []
    for i in range(1, 301):
        lines = [f"unique text of row {''.join(rng.choice('abcdefgh') for _ in range(14))}"]
        for k, b in enumerate(bank):
            if rng.random() < (0.5, 0.05, 0.02, 0.01, 0.3)[k]:
                lines.append(rng.choice((b, b.upper() + "!", " " + b.replace(" ", "  "))))
        lines += ["short one"] * 2
        rng.shuffle(lines)
        rows.append((i, rng.choice(["hot", "hot", "b", None]), talk("\n".join(lines), None if i % 9 == 0 else "\n".join(lines[:1]))))
    rows += [(1000, "b", None), (1001, "b", [])]
    df = spark.createDataFrame(rows, f"rec_id bigint, model string, conversation {CONV}")
    letters = lambda s: re.sub(r"[\W\d_]+", "", s.lower())
    seen, size = {}, {}
    for i, m, c in rows:
        if m is None:
            continue
        size[m] = size.get(m, 0) + 1
        for t in c or []:
            for line in (t["content"] or "").split("\n"):
                if len(letters(line)) >= 20:
                    seen.setdefault((m, letters(line)), set()).add(i)
    bad = {k for k, s in seen.items() if len(s) >= 5 and len(s) * 50 >= size[k[0]]}
    expect = {(i, ti, li) for i, m, c in rows for ti, t in enumerate(c or []) for li, line in enumerate((t["content"] or "").split("\n")) if (m, letters(line)) in bad}
    got = {tuple(r) for r in repeated_lines.repeated_lines(clash(df)).collect()}
    assert got == expect and expect
    cleaned = [{r["rec_id"]: r["conversation"] for r in repeated_lines.remove_repeated_lines(clash(df), bound=b).collect()} for b in (repeated_lines.BROADCAST_ROWS, 0)]
    assert cleaned[0] == cleaned[1]
    clean = cleaned[0]
    for i, m, c in rows:
        if c is None:
            assert clean[i] is None
            continue
        for t, g in zip(c, clean[i]):
            keep = None if t["content"] is None else "\n".join(x for x in t["content"].split("\n") if (m, letters(x)) not in bad)
            assert g["content"] == keep


def test_more_tied_lines_than_a_summary_holds(spark):
    def word(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(4))

    tied = [f"one of very many repeated lines {word(k)}" for k in range(repeated_lines.CAPACITY + 300)]
    rows = [(i, "copies", talk("\n".join(tied))) for i in range(1, 11)]
    rows += [(i, "other", talk(f"a line that only {word(i)} has in itself\nand a line that all of them have")) for i in range(11, 21)]
    df = spark.createDataFrame(rows, f"rec_id bigint, model string, conversation {CONV}")
    got = {tuple(r) for r in repeated_lines.repeated_lines(df).collect()}
    assert got == {(i, 0, k) for i in range(1, 11) for k in range(len(tied))} | {(i, 0, 1) for i in range(11, 21)}
    clean = {r["rec_id"]: r["conversation"][0]["content"] for r in repeated_lines.remove_repeated_lines(df).collect()}
    assert clean == {i: "" if i < 11 else f"a line that only {word(i)} has in itself" for i in range(1, 21)}


def test_overflowing_summaries_of_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(repeated_lines, "CAPACITY", 64)
    rng = random.Random(3)
    text = lambda: "\n".join("one line of its own " + "".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(100))
    notice = "this very notice stands in a few rows"
    rows = [(i, "m", talk(text() + ("\n" + notice if i % 40 == 0 else ""))) for i in range(1, 201)]
    df = spark.createDataFrame(rows, f"rec_id bigint, model string, conversation {CONV}").repartition(8)
    assert {tuple(r) for r in repeated_lines.repeated_lines(df).collect()} == {(i, 0, 100) for i in range(40, 201, 40)}


def test_summaries_keep_every_heavy_line():
    import numpy as np

    rng = np.random.default_rng(1)
    s, true = repeated_lines._Summary(), {}
    for _ in range(30):
        keys = np.concatenate([rng.integers(0, 5000, 200), np.repeat(np.arange(5), 20)])
        u, c = np.unique(keys, return_counts=True)
        for k, n in zip(u.tolist(), c.tolist()):
            true[k] = true.get(k, 0) + n
        s.add(u, c, 64)
    held = dict(zip(s.keys.tolist(), s.counts.tolist()))
    assert len(held) <= 64
    for k, n in true.items():
        assert held.get(k, 0) <= n <= held.get(k, 0) + s.error


MSG = "row_id bigint, url string, message_index string, role string, plain_text string, model string"


def messages():
    ok = [("0", "User", "q"), (" 01", "LLM", "a"), ("2", "human", "q2"), ("3", "ai", "a2")]
    cases = {
        "ok": ok, "later": [(str(int(i) + 7), r, t) for i, r, t in ok], "copies": ok + ok[:2], "null index": [*ok[:1], (None, "ai", "x")], "word index": [("n/a", "user", "q"), *ok[1:2]],
        "decimal": [("1.0", "user", "q"), ("2", "ai", "a")], "clash": [*ok, ("3", "ai", "other")], "gap": [ok[0], ok[1], ("4", "user", "q"), ("5", "ai", "a")], "one": ok[:1],
        "order": [("0", "user", "q"), ("1", "user", "q"), ("2", "ai", "a"), ("3", "ai", "a")], "assistant first": [("0", "ai", "a"), ("1", "user", "q")], "system": [("0", "system", "s"), ("1", "user", "q"), ("2", "ai", "a")],
        "blank": [("0", "user", " 　\t"), ("1", "ai", "a")], "null text": [("0", "user", "q"), ("1", "ai", None)], "unanswered": [*ok[:2], ("2", "user", "q")], "null role": [("0", None, "q"), ("1", "ai", "a")],
        "": ok, "negative": [("-1", "user", "q"), ("0", "ai", "a")],
    }
    rows = [(u, i, r, t, "m") for u, ms in cases.items() for i, r, t in ms] + [(None, *ok[0], "m")]
    random.Random(3).shuffle(rows)
    return [(n, *r) for n, r in enumerate(rows)]


def test_rebuild(spark):
    df = spark.createDataFrame(messages(), MSG)
    dropped = {r[0] for r in rebuild.dropped_conversations(clash(df)).collect()}
    kept = {"ok", "later", "copies", "negative"}
    assert dropped == {r[1] for r in messages() if r[1]} - kept
    whole = {r["url"]: [(t["role"], t["content"]) for t in r["conversation"]] for r in rebuild.rebuild_conversations(clash(df)).collect()}
    assert set(whole) == kept and whole["copies"] == whole["later"] == [("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "a2")]
    assert rebuild.dropped_conversations(df.limit(0)).count() == 0


def test_event_versions(spark):
    rows = [(1, "u", "0", "user", "old", "m", "create", 1), (2, "u", "0", "user", "new", "m", "edit", 2), (3, "u", "1", "ai", "a", "m", "create", 1),
            (4, "u", "2", "user", "gone", "m", "create", 1), (5, "u", "2", "user", "gone", "m", "delete", 2), (6, "w", "0", "user", "x", "m", "create", 1), (7, "w", "1", "ai", "y", "m", "create", 1), (8, "w", "1", "ai", "y", "m", "delete", 3)]
    df = spark.createDataFrame(rows, MSG + ", what string, ver int")
    got = {r["url"]: [t["content"] for t in r["conversation"]] for r in rebuild.rebuild_conversations(df, "what", "ver").collect()}
    assert got == {"u": ["new", "a"]} and [r[0] for r in rebuild.dropped_conversations(df, "what", "ver").collect()] == ["w"]


def canonical(r):
    only = lambda s: "".join(ch for ch in (s or "").lower() if ch.isalpha() or ch.isdecimal())
    turns = None if r[2] is None else tuple((t["role"], only(t["content"])) for t in r[2])
    try:
        meta = json.dumps(json.loads(r[3]), sort_keys=True) if r[3] is not None else None
    except ValueError:
        meta = "raw" + r[3]
    return r[1], turns, meta


def test_copies(spark):
    rng = random.Random(5)
    base = [talk("Héllo wörld 12", "ok then"), talk("Hello 你好!", "x"), talk("a", "b"), None, [], talk(None, "b"), talk("Hello world 1 2", "ok then")]
    metas = ['{"a":1,"b":[1,2]}', '{ "b": [1, 2], "a": 1 }', '{"a":"1","b":[1,2]}', "not json", None]

    def style(c):
        if not c:
            return c
        how = rng.choice((lambda s: s, str.upper, lambda s: f" * {s} …", lambda s: s.replace(" ", "　"), lambda s: s.replace(" ", "")))
        return [{"role": t["role"], "content": None if t["content"] is None else how(t["content"])} for t in c]

    rows = [(i, rng.choice(["s", "t", None]) if rng.random() < 0.6 else "s", style(rng.choice(base) if rng.random() < 0.6 else base[0]), rng.choice(metas)) for i in range(1, 240)]
    df = clash(spark.createDataFrame(rows, f"rec_id bigint, source string, conversation {CONV}, meta string"))
    groups = {}
    for r in rows:
        groups.setdefault(canonical(r), []).append(r[0])
    assert {tuple(r) for r in copies.copy_pairs(df).collect()} == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    for batches in (1, 3):
        assert {tuple(r) for r in copies.fold_copies(df, batches).collect()} == {(min(g), len(g)) for g in groups.values()}


def test_a_kept_ledger_touches_matching_buckets_only(spark, tmp_path):
    import glob

    path = f"file://{tmp_path}/ledger"
    day = lambda rows: spark.createDataFrame(rows, f"rec_id bigint, source string, conversation {CONV}, meta string")
    first = [(i, "s", talk(f"text {i}", "r"), "{}") for i in range(1, 200)]
    assert copies.fold_copies(day(first), 1, path, "monday").count() == 199
    written = len(glob.glob(f"{tmp_path}/ledger/v1/bucket=*"))
    assert 32 < written <= copies.Ledger(spark, path).state["buckets"]
    late = day([(300, "s", talk("TEXT 7!", "R"), "{}"), (301, "s", talk("brand new", "r"), "{}"), (302, "s", talk("Text-7", "r"), " { } ")])
    assert {tuple(r) for r in copies.copy_pairs(late, 1, path, "tuesday").collect()} == {(7, 300), (7, 302)}
    assert len(glob.glob(f"{tmp_path}/ledger/v2/bucket=*")) <= 2
    again = copies.fold_copies(late, 1, path, "tuesday")  # a delivery that comes twice counts once
    assert {tuple(r) for r in again.where("copies > 1").collect()} == {(7, 3)} and again.count() == 200
    assert len(copies.Ledger(spark, path).read([3]).select("bucket").distinct().collect()) == 1


def test_a_hot_conversation_is_rebuilt_whole(spark):
    rows = [(k, "hot", str(k), "user" if k % 2 == 0 else "ai", f"t{k}", "m") for k in range(600)]
    rows += [(1000 + 2 * k + j, f"u{k}", str(j), ("user", "ai")[j], "x", "m") for k in range(300) for j in range(2)]
    got = rebuild.rebuild_turns(spark.createDataFrame(rows, MSG)).collect()
    assert len(got) == 1200 and {r["turn"] for r in got if r["url"] == "hot"} == set(range(600))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], REC)
    assert match_groups.match_groups(empty).count() == 0 and group_splits.contradicting_rows(empty).count() == 0
    assert repeated_lines.repeated_lines(empty).count() == 0 and repeated_lines.remove_repeated_lines(empty).count() == 0
    assert copies.copy_pairs(empty).count() == 0 and copies.fold_copies(empty).count() == 0
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert group_splits.assign_splits(empty, targets).count() == 0
