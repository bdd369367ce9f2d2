"""Problems 1 and 7 to 10: planted cases, brute force, round trips; nulls, empty and long texts."""

import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnloom.llm import encoding, language, leaks, packing, pii
from turnloom.session import table

CONV = "array<struct<role:string,content:string>>"
FINDER = pii.Finder({"ciara", "rovis"}, {"glomits", "weonill"})

POSITIVE = {
    "email": ["write to a.b+c@mail.example.", "<X_Y@DEEP.MAIL.EXAMPLE>", "me at joe[at]mail[dot]example now", "You can reach me at joe at mail dot example.", "joe (at) mail.example"],
    "phone": ["Call +1 (796) 555-0105 now", "tel 020 7946 0571", "+49 (0)30 23125-673", "0049 30 23125 875", "01 99 00 67 37", "573-555-0148", "(577) 555 0129", "My number is 07700900749."],
    "id_number": ["SSN 941 63 0754", "They asked for it: 929-61-3019.", "passport no. Z4521881", "national id 920217-6724", "tax number 99/916/11458", "ID card QH305695Z", "driving licence D166-6630-3757",
                  "card 4111 1111 1111 1111", "paid with 4111 1111 1111 1111 today", "GB82 WEST 1234 5698 7654 32", "It is registered under ZZ90488833954748826129."],
    "address": ["I live at 230 Saltmarsh Road, Dunmere 16202.", "Oldstraße 50a, 54541 Ostvale", "4 bis, rue du Fennel", "Calle Tollgate 6, 7.º C", "deliver it to 199 old kiln court apt 20d", "Flat 7, 96 Larkfield Street"],
    "name": ["I met Ciara Glomits.", "GLOMITS, CIARA wrote", "my name is ciara glomits", "Please sign it with Ciaxen Nondansted.", "Dr. Rovis Unknownson is in", "The letter is for Rovis B. Weonill."],
}
NEGATIVE = ["The Ciara 460 plotter jammed.", "The old Glomits mill closed in 1974.", "deploy@build60 over ssh", "The @property line", "The order 4834-77-755 is open.", "Lot 92-825-09 was returned.", "on 2023-05-15",
            "It sums to 1,212,5495 in total.", "version 4.19.981, build 2019", "Contact <PRESIDIO_ANONYMIZED_EMAIL_ADDRESS> or NAME_85.", "88 lanes and a road", "Es geht um Fall X855568.", "PLOT THE ROVIS CURVE FOR 606 SAMPLES.", "", "look at the dot on it", "Pixel size is 416x73 at 0.416."]


def test_pii_planted():
    for kind, texts in POSITIVE.items():
        for t in texts:
            assert kind in {k for _, _, k in FINDER.items(t)}, (kind, t, FINDER.items(t))
    for t in NEGATIVE:
        assert FINDER.items(t) == [], (t, FINDER.items(t))
    assert FINDER.redact("Hi Ciara Glomits, mail a@b.example ok?") == "Hi [NAME], mail [EMAIL] ok?"
    assert FINDER.items(FINDER.redact(" ".join(POSITIVE["email"]))) == [] and FINDER.redact(None) is None


GATED = {
    "address": ["Abito in Via Garibaldi 12.", "Travessa Nova 5", "12 impasse des Lilas", "12 allée des Roses", "Hauptstr. 5", "AV. Central 7", "Oldplatz\u2003\n3, ja"],
    "name": ["Dear Xaver Quandt, thanks", "Ask Dr. Xaver Quandt.", "sincerely,\nXaver Quandt", "(Señora Xenia Quandt)", "carta e para Xaver Quandt."],
    "id_number": ["passport no. 12AB345", "dni 1A2B3C4D5", "to confirm: GB61 WEST ABCD EFGH"],
}


def test_pii_gate_loses_nothing(monkeypatch):
    for kind, ts in GATED.items():
        for t in ts:
            assert kind in {k for _, _, k in FINDER.items(t)}, (kind, t)
    lists = (pii.NAME_WORDS, pii.ECHO_WORDS, pii.TITLES)
    texts = [f"{a}{w}{b}Xaver Quandt." for words in lists for w in pii.spellings(words) for a in ("", "so (") for b in (" ", ". ", ":\n", "  ")]
    texts += [f"{w} Quandt 5" for w in pii.spellings(pii.STREET_KINDS)] + [f"Quandt{w} 5" for w in pii.spellings(pii.STREET_STEMS)]
    texts += [f"5 {w} Quandt" for w in pii.spellings(pii.STREET_FR)] + [f"5 Quandt {w}" for w in pii.STREET_EN.split("|")]
    texts += [f"joe{a}mail{b}example" for a in ("@", "[at}", "( at )", "{ at]", " at ") for b in (".", " dot ", "[ dot)")]
    texts += [t for group in (GATED, POSITIVE) for ts in group.values() for t in (*ts, *map(str.upper, ts), *map(str.lower, ts))] + NEGATIVE
    gated = [FINDER.items(t) for t in texts]
    monkeypatch.setattr(pii.Finder, "may_hold", lambda self, text: True)
    assert [(t, g) for t, g in zip(texts, gated) if g != FINDER.items(t)] == []


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and not pii.luhn("") and not pii.luhn("0000")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433") and not pii.mod97("ab")


def test_pii_frames(spark):
    names = spark.createDataFrame([("Ciara", "given"), ("Glomits", "family"), (None, "given"), (" ", "family")], "name string, kind string")
    long = "word " * 60_000 + "a@b.example " + "x" * 200_000 + " a-b" * 50_000
    rows = [(1, [{"role": "user", "content": "mail a@b.example and c@d.example"}, {"role": "assistant", "content": None}, None]), (2, None), (3, []), (4, [{"role": "user", "content": long}]), (None, [{"role": "user", "content": ""}])]
    df = spark.createDataFrame(rows, f"rec_id bigint, conversation {CONV}").withColumn("texts", F.lit(1)).withColumn("kind", F.lit("k"))
    assert {tuple(r) for r in pii.found_kinds(df, names).collect()} == {(1, 0, "email"), (4, 0, "email")}
    out = {r["rec_id"]: r for r in pii.redacted(df, names).collect()}
    assert out[1]["conversation"][0]["content"] == "mail [EMAIL] and [EMAIL]" and out[1]["texts"] == 1 and out[2]["conversation"] is None
    assert pii.found_kinds(df.limit(0), names.limit(0)).count() == 0


WORDS = {
    "en": "the house stands near river with old garden and many people walk there every morning because water looks clear under trees".split(),
    "de": "das haus steht neben dem fluss mit altem garten und viele leute gehen dort jeden morgen weil wasser unter bäumen klar aussieht".split(),
    "fr": "la maison reste près du fleuve avec vieux jardin et beaucoup de gens marchent chaque matin parce que eau semble claire sous arbres".split(),
    "ru": "дом стоит около реки со старым садом и многие люди гуляют там каждое утро потому что вода кажется чистой под деревьями".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(9)).capitalize() + "."


def labelled(n=500):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(n):
        langs = [rng.choice(list(WORDS))]
        if rng.random() < 0.15:
            langs.append(rng.choice([x for x in WORDS if x != langs[0]]))
        label = {"en": "English", "de": "de-DE", "fr": "FRA", "ru": "russian"}[langs[0]]
        if rng.random() < 0.1:
            label = rng.choice([None, "", "und", "Unknown"])
        elif rng.random() < 0.1:
            label = {"en": "de", "de": "en", "fr": "en", "ru": "en"}[langs[0]]
        rows.append((i, label, [{"role": "user", "content": " ".join(sentence(rng, x) for x in langs for _ in range(2))}, {"role": "assistant", "content": sentence(rng, "fr")}]))
        truth[i] = (language.label_language(label), set(langs))
    return rows, truth


def test_language_held_out(spark):
    rows, truth = labelled()
    df = spark.createDataFrame(rows + [(9000, None, None), (9001, "en", [{"role": "user", "content": None}]), (9002, None, [{"role": "user", "content": "12 345 !!"}])], f"rec_id bigint, lang_label string, conversation {CONV}")
    got = {tuple(r) for r in language.label_cases(df.withColumn("segments", F.lit(0))).collect()}
    expect = {(i, x) for i, (label, langs) in truth.items() if label is None or langs != {label} for x in langs}
    assert len(got & expect) / len(expect) > 0.97 and len(got & expect) / len(got) > 0.97
    segments = language.row_segments(df)
    conf = language.row_languages(segments).agg(F.min("confidence").alias("a"), F.max("confidence").alias("b")).first()
    assert 0 < conf["a"] <= conf["b"] <= 1
    assert language.label_cases(df.limit(0)).count() == 0


def test_labels_and_long_text():
    assert [language.label_language(x) for x in ("English", "pt-BR", "zh_CN", "DEU", " fr ", "und", None, "Klingon")] == ["en", "pt", "zh", "de", "fr", None, None, "other"]
    model = language.fit([(r[1], [r[2][0]["content"]]) for r in labelled()[0]])
    c = language.Classifier(model)
    assert c.sentence("Das Haus steht neben dem Fluss mit altem Garten.")[0] == "de" and c.sentence("ok")[0] is None
    assert c.segments(["x" * 500_000, None, ""])[0][3] is None
    got = c.segments([" ".join(WORDS["en"] * 3 + WORDS["fr"] * 3)])  # no sentence marks at all
    assert {s[3] for s in got if s[3]} >= {"en", "fr"}


def test_packing(spark):
    rng = random.Random(8)
    cap = 100
    sizes = [rng.choice([rng.randint(1, 30), rng.randint(30, 99), 50, 50]) for _ in range(400)] + [0, 100, 101, 250, 1000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, tokens bigint").withColumn("part", F.lit(1))
    rows = packing.pack_documents(df.select("doc_id", "tokens"), cap).collect()
    fill, parts = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append((r["part"], r["first_token"], r["tokens"]))
        if r["container"] is not None:
            fill[r["container"]] += r["tokens"]
    for i, n in enumerate(sizes):
        p = sorted(parts[i])
        assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and (len(p) == 1) == (n <= cap)
        assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:]))
    assert max(fill.values()) <= cap and len(fill) <= 1.05 * sum(sizes) / cap + 1
    assert len({(r["container"], r["slot"]) for r in rows if r["container"] is not None}) == sum(r["container"] is not None for r in rows)
    assert packing.pack_documents(df.select("doc_id", "tokens").limit(0), cap).count() == 0
    for counts in ({100: 3}, {34: 7}, {51: 2, 49: 2, 1: 5}, {1: 1}):
        done = packing.pack_sizes(dict(counts), cap)
        got = collections.Counter()
        for s, k in done:
            assert sum(s) <= cap
            got.update({x: 0 for x in s})
            for x in s:
                got[x] += k
        assert got == collections.Counter(counts)


def test_token_counts(spark):
    enc = packing.load_encoder()
    texts = ["Hello world", "", None, "naïve 你好 <|endoftext|>", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_counts(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} and enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["Déjà", "你好"]
    tasks = [(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30])))) for i in range(12)] + [("null", None), ("twin", None)]
    tasks[-1] = ("twin", tasks[2][1])
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary + ["out"]) for _ in range(rng.choice([0, 3, 40, 200]))]
        if rng.random() < 0.5:
            src = (tasks[rng.randrange(12)][1]).split()
            n = rng.choice([8, 11, 12, 13, 25])
            k = rng.randrange(max(1, len(src) - n + 1))
            words[len(words) // 2 : len(words) // 2] = src[k : k + n]
        docs.append((i, rng.choice((" ", ", ", "\n")).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(500, None), (501, "")]
    split = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    expect = {(d, t) for d, x in docs for t, p in tasks if grams(split(x)) & grams(split(p))}
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("words", F.lit(1)).withColumn("task_id", F.lit("x"))
    tt = spark.createDataFrame(tasks, "task_id string, problem string").withColumn("doc_id", F.lit(1))
    assert {tuple(r) for r in leaks.leaked_pairs(dd, tt).collect()} == expect and expect
    text, problem = dict(docs), dict(tasks)
    for r in leaks.matches(dd, tt).collect():
        a, b = split(text[r["doc_id"]]), split(problem[r["task_id"]])
        i, j, n = r["doc_word"], r["task_word"], r["words"]
        assert a[i : i + n] == b[j : j + n] and a[i + n : i + n + 1] != b[j + n : j + n + 1] or i + n == len(a) or j + n == len(b)
    assert {r["doc_id"] for r in leaks.remove_leaked(dd, tt).collect()} == {d for d, _ in docs} - {d for d, _ in expect}
    assert leaks.leaked_pairs(dd.limit(0), tt).count() == 0 and leaks.leaked_pairs(dd, tt.limit(0)).count() == 0


def test_leaks_in_small_shards_and_blocks(spark, monkeypatch):
    task = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(i, "x y " + " ".join(f"v{k}" for k in range(i, i + 15))) for i in range(20)], "doc_id bigint, text string")
    tasks = spark.createDataFrame([(f"t{i}", task + f" z{i}") for i in range(5)], "task_id string, problem string")
    import numpy as np

    tests = leaks.Tests([("t", task.split())])
    ids = np.array([0, *range(1, 1)], np.int64)
    assert list(leaks.search_shard(ids, tests)) == []
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
    assert leaks.leaked_pairs(docs, tasks).count() == 100


CLEAN = {
    "en": "The café owner said “don’t worry” — it’s 40 € at −4 °C, naïve façade résumé.",
    "de": "Außerdem öffnet der Bäcker für größere Übungen die Tür, und zwar gründlich.",
    "fr": "La forêt contrôle une règle étrange près de la rivière, ça gêne l'élève.",
    "ru": "Говорят, что старый мельник обгоняет золотой ключ около реки каждое утро.",
    "pt": "ATENÇÃO: NÃO É VERDADE que a estação não alcança os pêssegos maduros.",
}


def garble(text, true, read):
    raw = text.encode(true)
    return "".join(bytes([b]).decode(read) if bytes([b]).decode(read, "ignore") else chr(b) for b in raw)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(1200):
        text = " ".join(CLEAN[rng.choice(list(CLEAN))] for _ in range(2))
        rows.append((i, rng.choice(["a", "b", None]), text))
    for k, (true, read, langs) in enumerate([("utf-8", "cp1252", "en de fr ru pt"), ("utf-8", "latin-1", "de fr"), ("utf-8", "mac_roman", "en fr"), ("utf-8", "cp437", "en de"), ("utf-8", "cp1251", "en de"), ("cp1251", "cp1252", "ru"), ("koi8_r", "cp1251", "ru")]):
        for lang in langs.split():
            for j in range(3):
                i = 2000 + len(truth)
                truth[i] = CLEAN[lang]
                rows.append((i, rng.choice(["a", "b", None]), garble(CLEAN[lang], true, read)))
    twice = 5000
    truth[twice] = CLEAN["fr"]
    rows.append((twice, "a", garble(garble(CLEAN["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")))
    rows += [(6000, "a", "lost � here"), (6001, "a", None), (6002, None, ""), (6003, "b", "plain ascii")]
    return rows, truth


def test_encoding_round_trip(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("n", F.lit(1)).withColumn("evidence", F.lit("x"))
    assert {r[0] for r in encoding.garbled_documents(df).collect()} == set(truth) | {6000}
    out = {r["doc_id"]: (r["text"], r["restored"]) for r in encoding.repaired_documents(df).collect()}
    assert out[6000][1] is False
    exact = sum(out[i][0] == t for i, t in truth.items())
    assert exact >= 0.95 * len(truth), [(i, out[i][0], t) for i, t in truth.items() if out[i][0] != t][:3]
    assert encoding.garbled_documents(df.limit(0)).count() == 0


def test_encoding_judges_short_runs_and_names_chains(corpus):
    rows, _ = corpus
    batch = pa.RecordBatch.from_pydict({"text": [r[2] for r in rows]})
    counts = next(encoding._count_pairs(iter([batch])))
    model = encoding.PairModel(counts.column("pair").to_numpy(), counts.column("n").to_numpy())
    assert encoding.evidence(CLEAN["de"], model) == {} and encoding.evidence(CLEAN["ru"], model) == {}
    word = next(w for w in CLEAN["fr"].split() if len(w) > 3 and sum(ord(c) > 127 for c in w) == 1)
    one = CLEAN["fr"].replace(word, garble(word, "cp1252", "mac_roman"), 1)  # a single wrong letter
    assert max(encoding.evidence(one, model), key=encoding.evidence(one, model).get).startswith("cp1252>") and encoding.repair(one, model, {}) == CLEAN["fr"]
    thrice = CLEAN["fr"]
    for _ in range(3):
        thrice = garble(thrice, "utf-8", "cp1252")
    found = encoding.evidence(thrice, model)
    assert max(found, key=found.get) == encoding.THEN.join(["utf_8>cp1252"] * 3) and encoding.repair(thrice, model, {}) == CLEAN["fr"]


def test_encoding_fields_have_their_own_priors(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    df = df.select("doc_id", "source", "text", F.when(F.col("doc_id") < 1200, F.col("text")).alias("title"))
    out = {(r["doc_id"], r["field"]) for r in encoding.repaired_documents(df, ("text", "title")).collect()}
    assert {d for d, f in out} == set(truth) | {6000} and {f for _, f in out} == {"text"}


def test_llm_queries_match_their_sql(spark, small_dir):
    import glob
    import os

    import duckdb

    from turnloom.llm import queries, sql

    con = duckdb.connect()
    for p in glob.glob(small_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, fn in queries.QUERIES.items():
        df = fn(spark, small_dir)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        if name in sql.SQL:
            cur = con.execute(sql.SQL[name])
            names = [d[0] for d in cur.description]
            assert sorted(names) == cols and got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall()), name
    assert table(spark, small_dir, "documents").count() > 0
