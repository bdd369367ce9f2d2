"""Queries of the curation stage: sources, dedup, templates, shared texts, groups, splits, corpus checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import conversation as C
from turnloom.operators import curation as Q
from turnloom.operators.graph import connected_components, star_links
from turnloom.plans import sqlkit as K
from turnloom.session import table
from turnloom.sources import readers as R
from turnloom.staging import Stage

#: The reference's proportions, as 60 per cent of each source's eligible records whatever their number; the
#: reference's own numbers (CurationConfig's defaults) are more than the test tables hold.
CONFIG = Q.CurationConfig(percent=60)
LOW_LIMIT = 20


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "interim_record")


def english_stats(spark: SparkSession, d: str) -> DataFrame:
    """Records with an English label, per source."""
    df = _records(spark, d).select("source", F.coalesce(F.col("lang_label").isin(*C.ENGLISH_LABELS), F.lit(False)).alias("english"))
    return df.groupBy("source", "english").agg(F.count("*").alias("n"))


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """H1: first row of each user text within a source."""
    return Q.first_seen(_records(spark, d).select("rec_id", "source", "user_text_hash"), ["source", "user_text_hash"], "rec_id")


SQL_EXACT = "SELECT min(rec_id) AS rec_id, source, user_text_hash FROM interim_record GROUP BY source, user_text_hash"


def clean_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Repeats by the marker-free user text, after conversations emptied by deletion are gone."""
    df = Q.with_clean(_records(spark, d).select("rec_id", "source", "conversation"))
    df = df.where(C.rejection_reason(F.col("clean_conversation")).isNull()).select("rec_id", "source", "clean_user_hash")
    return Q.first_seen(df, ["source", "clean_user_hash"], "rec_id", carry=True)


_CLEAN = f"""
c AS (SELECT rec_id, source, group_id, conv_id, presplit, {K.CLEAN_CONV} AS conversation FROM interim_record),
w AS (SELECT rec_id, source, group_id, conv_id, presplit, md5({K.norm(K.user_text())}) AS clean_user_hash, md5({K.norm(K.opener())}) AS clean_first_hash,
  len({K.split_words(K.user_text())}) AS clean_words, len({K.split_words(K.opener())}) AS clean_first_words FROM c
  WHERE NOT list_bool_or(list_transform(conversation, lambda t: regexp_replace(t.content, '{K.WS}', '', 'g') = '')))
"""
_ALL_CLEAN = _CLEAN[: _CLEAN.index("  WHERE NOT list_bool_or")] + ")"
SQL_CLEAN_DEDUP = f"WITH {_CLEAN} SELECT min(rec_id) AS rec_id, source, clean_user_hash FROM w GROUP BY source, clean_user_hash"


def template_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records whose opening prompt holds a 7-gram that occurs more than LOW_LIMIT times in the source."""
    df = _records(spark, d).select("rec_id", "source", C.first_user_turn(F.col("conversation")).alias("opener"))
    return Q.template_rows(df, F.col("opener"), 7, LOW_LIMIT, "rec_id")


_GRAMS = f"""
o AS (SELECT rec_id, source, {K.split_words(f"lower({K.opener()})")} AS w FROM interim_record),
g AS (SELECT rec_id, source, unnest(list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i:i+6], ' '))) AS gram FROM o WHERE len(w) >= 7)
"""
SQL_TEMPLATE = f"""
WITH {_GRAMS}, k AS (SELECT source, gram FROM g GROUP BY ALL HAVING count(*) > {LOW_LIMIT})
SELECT DISTINCT rec_id FROM g JOIN k USING (source, gram)
"""


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Opening-prompt 7-grams with more than one occurrence."""
    df = _records(spark, d).select("source", C.first_user_turn(F.col("conversation")).alias("opener"))
    return Q.ngram_counts(df, F.col("opener"), 7).where("n > 1")


SQL_NGRAMS = f"WITH {_GRAMS} SELECT source, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1"


def cross_source_texts(spark: SparkSession, d: str) -> DataFrame:
    """User texts of five words or more that occur in several sources."""
    df = _records(spark, d).select("source", F.col("user_text_hash").alias("h"), F.col("n_words_user").alias("w")).where(F.col("h").isNotNull())
    return Q.shared_texts(df, "h", "w")


SQL_CROSS = "SELECT user_text_hash AS h FROM interim_record WHERE user_text_hash IS NOT NULL AND n_words_user >= 5 GROUP BY 1 HAVING count(DISTINCT source) > 1"


def drop_shared(spark: SparkSession, d: str) -> DataFrame:
    """rows left per source without the shared texts."""
    df = _records(spark, d).select("source", F.col("user_text_hash").alias("h"), F.col("n_words_user").alias("w"))
    left = df.join(Q.shared_texts(df.where(F.col("h").isNotNull()), "h", "w"), "h", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("n"))


SQL_DROP = f"SELECT source, count(*) AS n FROM interim_record WHERE user_text_hash IS NULL OR user_text_hash NOT IN ({SQL_CROSS}) GROUP BY source"


def superseded(spark: SparkSession, d: str) -> DataFrame:
    """conversations of the later release whose id the earlier one lacks."""
    df = _records(spark, d).select("rec_id", "source", "conv_id")
    return Q.not_in_earlier(df.where("source = 'wildchat_4p8m'"), df.where("source = 'wildchat_1m'")).select("rec_id")


SQL_SUPERSEDED = """
SELECT rec_id FROM interim_record l WHERE source = 'wildchat_4p8m'
  AND NOT EXISTS (SELECT 1 FROM interim_record e WHERE e.source = 'wildchat_1m' AND e.conv_id = l.conv_id)
"""


def ambiguous_order(spark: SparkSession, d: str) -> DataFrame:
    """Urls with a repeated raw message index."""
    return R.ambiguous_urls(table(spark, d, "sharechat_row"))


SQL_AMBIGUOUS = "SELECT url FROM sharechat_row WHERE url <> '' GROUP BY url HAVING count(*) > count(DISTINCT message_index) + CAST(bool_or(message_index IS NULL) AS INT)"


def message_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Per-url language, model and timestamp of message rows."""
    return R.message_metadata(table(spark, d, "sharechat_row"), "row_id")


SQL_MESSAGE_META = """
WITH r AS (SELECT *, coalesce(try_cast(trim(message_index) AS BIGINT), 0) AS ix, lower(role) IN ('user', 'human') AS u,
    lower(role) IN ('llm', 'assistant', 'model', 'chatbot', 'ai') AS a FROM sharechat_row WHERE url <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ix, row_id) AS k FROM r),
g AS (SELECT url, list_sort(list_distinct(list(coalesce(detected_language_final, '')) FILTER (u))) AS langs,
  arg_min(model, k) FILTER (a AND model <> '') AS model,
  arg_min(coalesce(nullif(created_at, ''), nullif(create_time, ''), nullif(message_create_time, ''), nullif(published_at, '')), k) FILTER (k = 1) AS ts FROM o GROUP BY url)
SELECT url, CASE WHEN len(langs) > 0 AND len(list_filter(langs, lambda x: x NOT IN ('English', 'english', 'en', 'EN', 'eng'))) = 0 THEN 'English'
  WHEN len(langs) = 1 THEN langs[1] END AS lang_label, coalesce(model, '') AS model, ts AS timestamp FROM g
"""


def message_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Conversations nested from message rows by integer index (ties in row order)."""
    out = R.messages_to_conversations(table(spark, d, "sharechat_row"), "row_id")
    return out.select("conv_id", F.size("conversation").alias("n"), F.md5(F.array_join(F.transform("conversation", lambda t: F.concat(t["role"], F.lit("\x01"), t["content"])), "\x02")).alias("digest"))


SQL_NESTING = """
WITH r AS (SELECT url, coalesce(try_cast(trim(message_index) AS BIGINT), 0) AS ix, row_id,
    CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('llm', 'assistant', 'model', 'chatbot', 'ai') THEN 'assistant'
      ELSE 'unknown:' || lower(coalesce(role, '')) END AS role, coalesce(plain_text, '') AS txt FROM sharechat_row WHERE url <> '')
SELECT url AS conv_id, CAST(count(*) AS INT) AS n, md5(string_agg(role || chr(1) || txt, chr(2) ORDER BY ix, row_id)) AS digest FROM r GROUP BY url
"""


def mixed_language(spark: SparkSession, d: str) -> DataFrame:
    """Sharechat records whose released user-language labels are empty or not all English."""
    df = _records(spark, d).where("source = 'sharechat'")
    return df.where(~Q.labels_all_english(Q.released_labels(F.col("meta")))).select("rec_id")


SQL_MIXED = """
SELECT rec_id FROM interim_record WHERE source = 'sharechat' AND (json_array_length(meta, '$.user_language_labels') IS NULL OR json_array_length(meta, '$.user_language_labels') = 0
  OR len(list_filter(CAST(json_extract(meta, '$.user_language_labels') AS VARCHAR[]), lambda x: x IS NULL OR x NOT IN ('English', 'english', 'en', 'EN', 'eng'))) > 0)
"""


def session_longest(spark: SparkSession, d: str) -> DataFrame:
    """Per group the record with the longest conversation, then latest timestamp text, then id."""
    df = _records(spark, d).select("rec_id", "group_id", "n_turns", F.coalesce("timestamp", F.lit("")).alias("ts"))
    return Q.sessions_longest(df, "group_id", [F.col("n_turns"), F.col("ts"), F.col("rec_id")]).select("group_id", "rec_id")


SQL_SESSION = """
SELECT group_id, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n_turns DESC, coalesce(timestamp, '') DESC, rec_id DESC) AS k FROM interim_record) WHERE k = 1
"""


def user_group_key(spark: SparkSession, d: str) -> DataFrame:
    """A2: group key from an address and a country, else from source and conversation id (taken from meta)."""
    df = _records(spark, d).where("source LIKE 'wildchat%'")
    ip = F.when(F.instr("group_id", "_") > 0, F.substring_index("group_id", "_", 1))
    return df.select("rec_id", R.user_group(ip, F.get_json_object("meta", "$.country"), F.col("source"), F.col("conv_id")).alias("key"))


SQL_GROUP_KEY = """
SELECT rec_id, CASE WHEN instr(replace(group_id, source, ''), '_') > 0 OR instr(group_id, '_') > 0
  THEN split_part(group_id, '_', 1) || '_' || coalesce(nullif(json_extract_string(meta, '$.country'), ''), 'unknown') ELSE source || ':' || conv_id END AS key
FROM interim_record WHERE source LIKE 'wildchat%'
"""


def _linked(spark: SparkSession, d: str) -> tuple[Stage, DataFrame, DataFrame]:
    stage = Stage(spark, "groups")
    kept = stage.write(Q.with_clean(_records(spark, d).select("rec_id", "source", "group_id", "presplit", "conversation")), "kept")
    return stage, kept, stage.write(Q.link_groups(stage, kept), "components")


def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups by user, user text and long opening prompt; component = smallest rec_id."""
    return _linked(spark, d)[2]


_COMPONENTS = f"""
{_ALL_CLEAN},
k AS (SELECT rec_id, 'g' || CASE WHEN source LIKE 'wildchat%' THEN 'wildchat' ELSE source END || chr(1) || group_id AS key FROM w
  UNION ALL SELECT rec_id, 'u' || clean_user_hash FROM w UNION ALL SELECT rec_id, 'f' || clean_first_hash FROM w WHERE clean_first_words >= 5),
m AS (SELECT key, min(rec_id) AS rep FROM k GROUP BY key),
e AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM (SELECT rec_id, rep FROM k JOIN m USING (key)) a JOIN (SELECT rec_id, rep FROM k JOIN m USING (key)) b USING (rec_id) WHERE a.rep <> b.rep),
reach(a, b) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
comp AS (SELECT k.rec_id, min(root.component) AS component FROM k JOIN m USING (key) JOIN root ON root.a = m.rep GROUP BY k.rec_id)
"""
SQL_COMPONENTS = f"WITH RECURSIVE {_COMPONENTS} SELECT rec_id, component FROM comp"


def constraint_masks(spark: SparkSession, d: str) -> DataFrame:
    """Permitted splits of each connected group as a bit mask."""
    _, kept, comps = _linked(spark, d)
    return Q.constraint_masks(kept.select("rec_id", "source", "presplit").join(comps, "rec_id"))


SQL_MASKS = f"""
WITH RECURSIVE {_COMPONENTS},
x AS (SELECT component, bit_and(CASE WHEN source <> 'hh_rlhf' THEN 7 WHEN presplit = 'test' THEN 4 ELSE 3 END) AS m FROM w JOIN comp USING (rec_id) GROUP BY component)
SELECT component, CAST(CASE WHEN m = 0 THEN 4 ELSE m END AS INT) AS mask, m = 0 AS conflict FROM x
"""


def split_assign(spark: SparkSession, d: str) -> DataFrame:
    """Split of every record that stays, source by source, with the records chosen for the corpus."""
    stage, kept, comps = _linked(spark, d)
    return Q.assign_splits(stage, kept, comps, CONFIG)


_ORDER = (*Q.KEPT_WHOLE, *(s for s in Q.SOURCES if s not in Q.KEPT_WHOLE))


def _mat(ctes: str) -> str:
    return ctes.replace(" AS (", " AS MATERIALIZED (")


def _assigned(w: str, comp: str) -> str:
    """CTEs of the greedy assignment, written source by source as the rule is stated, ending in ``final``.

    ``w`` has rec_id, source and presplit, ``comp`` rec_id and component.
    """
    total = sum(CONFIG.sizes.values())

    def cap(src: str, split: str) -> str:
        n = f"(SELECT count(*) FROM ar WHERE source = '{src}')"
        if src not in Q.KEPT_WHOLE:
            return f"({n} * {CONFIG.percent} * {CONFIG.sizes[split]} // {100 * total})"
        part = {s: f"CAST(round_even({n} * {CONFIG.sizes[s]} / {float(total)}, 0) AS BIGINT)" for s in ("val", "test")}
        return part.get(split) or f"({n} - {part['val']} - {part['test']})"

    out = [
        f"am AS (SELECT component, bit_and(CASE WHEN source <> 'hh_rlhf' THEN 7 WHEN presplit = 'test' THEN 4 ELSE 3 END) AS m FROM {w} JOIN {comp} USING (rec_id) GROUP BY component)",
        "ai AS (SELECT component, CASE WHEN m = 0 THEN 4 ELSE m END AS mask FROM am)",
        f"ar AS (SELECT rec_id, source, component, mask FROM {w} JOIN {comp} USING (rec_id) JOIN ai USING (component) WHERE (CASE WHEN source <> 'hh_rlhf' THEN 7 WHEN presplit = 'test' THEN 4 ELSE 3 END) & mask <> 0)",
        f"ag AS (SELECT source, component, count(*) AS n, min(mask) AS mask, md5('{CONFIG.seed}:' || source || ':' || component) AS h FROM ar GROUP BY source, component)",
        "p0 AS (SELECT component, CASE mask WHEN 4 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS split FROM ai WHERE mask IN (1, 2, 4))",
    ]
    for k, src in enumerate(_ORDER, 1):
        prev = f"p{k - 1}"
        for split, bit, taken in (("test", 4, ""), ("val", 2, f" AND component NOT IN (SELECT component FROM t{k}test)")):
            held = f"(SELECT coalesce(sum(n), 0) FROM ag JOIN {prev} USING (component) WHERE source = '{src}' AND split = '{split}')"
            out.append(
                f"t{k}{split} AS (SELECT component, '{split}' AS split FROM (SELECT component, coalesce(sum(n) OVER (ORDER BY h, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
                f"FROM ag WHERE source = '{src}' AND mask & {bit} <> 0 AND component NOT IN (SELECT component FROM {prev}){taken}) WHERE before + {held} < {cap(src, split)})")
        out.append(
            f"q{k} AS (SELECT * FROM {prev} UNION ALL SELECT * FROM t{k}test UNION ALL SELECT * FROM t{k}val)")
        out.append(f"p{k} AS (SELECT * FROM q{k} UNION ALL SELECT component, 'train' FROM ag WHERE source = '{src}' AND component NOT IN (SELECT component FROM q{k}))")
    caps = " ".join(f"WHEN source = '{src}' AND split = '{s}' THEN {cap(src, s)}" for src in _ORDER for s in Q.SPLITS)
    out.append(
        f"final AS (SELECT rec_id, source, component, split, source IN ('sharegpt') OR k <= CASE {caps} END AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY source, split "
        f"ORDER BY {K.order(CONFIG.seed, 'rec_id')}, rec_id) AS k FROM ar JOIN p{len(_ORDER)} USING (component)))")
    return ",\n".join(_mat(x) for x in out)


SQL_ASSIGN = f"WITH RECURSIVE {_mat(_COMPONENTS)}, {_assigned('w', 'comp')} SELECT rec_id, source, component, split, chosen FROM final"
SQL_SPLITS = f"WITH RECURSIVE {_mat(_COMPONENTS)}, {_assigned('w', 'comp')} SELECT source, split, count(*) AS pool, count(*) FILTER (chosen) AS chosen FROM final GROUP BY source, split"


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pool and chosen counts per source and split."""
    out = split_assign(spark, d)
    return out.groupBy("source", "split").agg(F.count("*").alias("pool"), F.count_if("chosen").alias("chosen"))


def curation_stages(spark: SparkSession, d: str) -> DataFrame:
    """Records left after each filter of the build."""
    cols = ("rec_id", "source", "conv_id", "group_id", "presplit", "conversation", "meta", "user_text_hash")
    return Q.filter_records(Stage(spark, "curation"), _records(spark, d).select(*cols), CONFIG)[1]


_USER_BLANK = "regexp_replace(coalesce(t.content, ''), '{ws}', '', 'g') = ''".format(ws=K.WS)


def _valid(conv: str) -> str:
    ok = f"list_transform({conv}, lambda t, i: coalesce(t.role, '') = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END AND NOT {_USER_BLANK})"
    return f"coalesce(len({conv}) >= 2 AND list_bool_and({ok}), false)"


_FILTERED = f"""
b0 AS (SELECT rec_id, source, conv_id, group_id, CASE WHEN source = 'hh_rlhf' THEN presplit END AS presplit, conversation, meta, user_text_hash FROM interim_record WHERE {_valid("conversation")}),
b1 AS (SELECT * FROM b0 WHERE NOT (source = 'wildchat_4p8m' AND conv_id IS NOT NULL AND conv_id IN (SELECT conv_id FROM b0 WHERE source = 'wildchat_1m' AND conv_id IS NOT NULL))
  AND (source <> 'sharechat' OR coalesce(json_array_length(meta, '$.user_language_labels') > 0
    AND len(list_filter(CAST(json_extract(meta, '$.user_language_labels') AS VARCHAR[]), lambda x: x IS NULL OR x NOT IN ('English', 'english', 'en', 'EN', 'eng'))) = 0, false))),
b2 AS (SELECT * FROM b1 WHERE rec_id IN (SELECT min(rec_id) FROM b1 GROUP BY source, user_text_hash)),
bo AS (SELECT rec_id, source, {K.split_words(f"lower({K.opener()})")} AS w FROM b2),
bg AS (SELECT rec_id, source, unnest(list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i:i+6], ' '))) AS gram FROM bo WHERE len(w) >= 7),
bt AS (SELECT DISTINCT rec_id FROM bg JOIN (SELECT source, gram FROM bg GROUP BY ALL HAVING count(*) > {CONFIG.template_limit}) USING (source, gram)),
b3 AS (SELECT rec_id, source, conv_id, group_id, presplit, {K.CLEAN_CONV} AS conversation FROM b2 WHERE rec_id NOT IN (SELECT rec_id FROM bt)),
b4 AS (SELECT *, md5({K.norm(K.user_text())}) AS clean_user_hash, md5({K.norm(K.opener())}) AS clean_first_hash,
  len({K.split_words(K.user_text())}) AS clean_words, len({K.split_words(K.opener())}) AS clean_first_words FROM b3 WHERE {_valid("conversation")}),
b5 AS (SELECT * FROM b4 WHERE rec_id IN (SELECT min(rec_id) FROM b4 GROUP BY source, clean_user_hash)),
w AS (SELECT * FROM b5 WHERE clean_user_hash NOT IN (SELECT clean_user_hash FROM b5 WHERE clean_words >= 5 GROUP BY 1 HAVING count(DISTINCT source) > 1))
"""
_STEPS = (("english", "interim_record"), ("chosen", "b1"), ("after_exact_dedup", "b2"), ("after_template_filter", "b3"), ("after_marker_deletion", "b5"), ("eligible", "w"))
SQL_STAGES = f"WITH {_mat(_FILTERED)} " + " UNION ALL ".join(f"SELECT source, '{name}' AS stage, count(*) AS n FROM {t} GROUP BY source" for name, t in _STEPS)
_LINKS = _COMPONENTS[_COMPONENTS.index("k AS (SELECT rec_id, 'g'") :]
_CORPUS_RULES = f"""
z AS (SELECT w.*, split FROM w JOIN final USING (rec_id) WHERE chosen),
u AS (SELECT *, CASE WHEN source LIKE 'wildchat%' THEN 'wildchat' ELSE source END || chr(1) || group_id AS person FROM z),
v AS (SELECT 'repeated id' AS rule, count(*) AS n FROM (SELECT 1 FROM z GROUP BY source, conv_id HAVING count(*) > 1)
  UNION ALL SELECT 'repeated text', count(*) FROM (SELECT 1 FROM z GROUP BY source, clean_user_hash HAVING count(*) > 1)
  UNION ALL SELECT 'shared text', count(*) FROM (SELECT 1 FROM z WHERE clean_words >= 5 GROUP BY clean_user_hash HAVING count(DISTINCT source) > 1)
  UNION ALL SELECT 'structure', count(*) FROM z WHERE NOT {_valid("conversation")}
  UNION ALL SELECT 'split', count(*) FROM z WHERE source = 'hh_rlhf' AND (presplit IS NOT DISTINCT FROM 'test') <> (split = 'test')
  UNION ALL SELECT 'user crosses', count(*) FROM (SELECT 1 FROM u GROUP BY person HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'text crosses', count(*) FROM (SELECT 1 FROM z GROUP BY clean_user_hash HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'opening crosses', count(*) FROM (SELECT 1 FROM z WHERE clean_first_words >= 5 GROUP BY clean_first_hash HAVING count(DISTINCT split) > 1))
"""
SQL_CHECK = f"WITH RECURSIVE {_mat(_FILTERED)}, {_mat(_LINKS)}, {_assigned('w', 'comp')}, {_mat(_CORPUS_RULES)} SELECT rule, n FROM v WHERE n > 0"


def corpus_check(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the built corpus by rule; no rows for a sound corpus."""
    corpus, _ = Q.build_corpus(_records(spark, d), CONFIG, strict=False)
    return Q.corpus_violations(corpus).groupBy("rule").agg(F.count("*").alias("n"))


def raw_violations(spark: SparkSession, d: str) -> DataFrame:
    """J1 on the uncurated table, every record put into train: repeated ids and texts show up."""
    raw = Q.with_clean(_records(spark, d).select("rec_id", "source", "conv_id", "group_id", "presplit", "conversation")).withColumn("split", F.lit("train"))
    return Q.corpus_violations(raw).groupBy("rule").agg(F.count("*").alias("n"))


SQL_RAW = f"""
WITH {_ALL_CLEAN}
SELECT 'repeated id' AS rule, count(*) AS n FROM (SELECT 1 FROM w GROUP BY source, conv_id HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'repeated text', count(*) FROM (SELECT 1 FROM w GROUP BY source, clean_user_hash HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'shared text', count(*) FROM (SELECT 1 FROM w WHERE clean_words >= 5 GROUP BY clean_user_hash HAVING count(DISTINCT source) > 1) HAVING count(*) > 0
UNION ALL SELECT 'split', count(*) FROM w WHERE source = 'hh_rlhf' AND presplit = 'test' HAVING count(*) > 0
"""


def nested_fraction(spark: SparkSession, d: str) -> DataFrame:
    """H9: a quarter of each source in a fixed hash order."""
    return Q.nested_fraction(_records(spark, d).select("rec_id", "source"), ["source"], "rec_id", 0.25, "42")


def _round_even(x: str) -> str:
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END"


SQL_FRACTION = f"""
SELECT rec_id, source FROM (SELECT rec_id, source, row_number() OVER (PARTITION BY source ORDER BY {K.order('42', 'rec_id')}, rec_id) AS k,
  count(*) OVER (PARTITION BY source) AS n FROM interim_record) WHERE k <= {_round_even("(n * 0.25)")}
"""


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """B2: order-free fingerprint of the task table."""
    df = table(spark, d, "task").select("task_id", "gold")
    h = F.conv(F.substring(F.md5(F.concat_ws("\x01", "task_id", "gold")), 1, 13), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


SQL_FINGERPRINT = "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(task_id || chr(1) || gold), 1, 13) AS BIGINT)) AS VARCHAR) AS digest FROM task"


def release_overlap(spark: SparkSession, d: str) -> DataFrame:
    """I9, set operations: ids in both releases, in one only, as multiset counts."""
    df = _records(spark, d).select("source", "conv_id")
    a, b = (df.where(F.col("source") == s).select("conv_id") for s in ("wildchat_1m", "wildchat_4p8m"))
    parts = (("both", a.intersect(b)), ("first only", a.exceptAll(b)), ("second only", b.exceptAll(a)))
    out = None
    for name, x in parts:
        one = x.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


SQL_OVERLAP = """
WITH a AS (SELECT conv_id FROM interim_record WHERE source = 'wildchat_1m'), b AS (SELECT conv_id FROM interim_record WHERE source = 'wildchat_4p8m')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT 'second only', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
"""

CATALOGUE = {
    "english_stats": (english_stats, "SELECT source, coalesce(lang_label IN ('English', 'english', 'en', 'EN', 'eng'), false) AS english, count(*) AS n FROM interim_record GROUP BY ALL"),
    "exact_dedup": (exact_dedup, SQL_EXACT),
    "clean_dedup": (clean_dedup, SQL_CLEAN_DEDUP),
    "template_filter": (template_filter, SQL_TEMPLATE),
    "ngram_counts": (ngram_counts, SQL_NGRAMS),
    "cross_source_texts": (cross_source_texts, SQL_CROSS),
    "drop_shared": (drop_shared, SQL_DROP),
    "superseded": (superseded, SQL_SUPERSEDED),
    "ambiguous_order": (ambiguous_order, SQL_AMBIGUOUS),
    "message_metadata": (message_metadata, SQL_MESSAGE_META),
    "message_nesting": (message_nesting, SQL_NESTING),
    "mixed_language": (mixed_language, SQL_MIXED),
    "session_longest": (session_longest, SQL_SESSION),
    "user_group_key": (user_group_key, SQL_GROUP_KEY),
    "components": (components, SQL_COMPONENTS),
    "constraint_masks": (constraint_masks, SQL_MASKS),
    "split_assign": (split_assign, SQL_ASSIGN),
    "split_counts": (split_counts, SQL_SPLITS),
    "curation_stages": (curation_stages, SQL_STAGES),
    "corpus_check": (corpus_check, SQL_CHECK),
    "raw_violations": (raw_violations, SQL_RAW),
    "nested_fraction": (nested_fraction, SQL_FRACTION),
    "fingerprint": (fingerprint, SQL_FINGERPRINT),
    "release_overlap": (release_overlap, SQL_OVERLAP),
}
