"""Problem 7: missing or wrong language labels, by compression against per-language dictionaries.

Each sentence is compressed with every zstandard raw-content dictionary of its script; the smallest output names
the language, a narrow margin rejects the sentence, and the confidence comes from all the sizes. The dictionaries
are fitted on a bounded sample of labelled rows (SAMPLE_ROWS per language). As labels can be wrong, a sentence
enters a dictionary only where word statistics of the whole sample agree with its label.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Languages with their codes and English names.
LANGUAGES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "chinese"),
}
NO_LABEL = ("", "und", "unknown")
#: Bounded sample for the fit: rows per labelled language, characters used of them per language, and of one row.
#: So the driver gets at most len(LANGUAGES) * (SAMPLE_CHARS + ROW_CHARS) characters, whatever the input.
SAMPLE_ROWS, SAMPLE_CHARS, ROW_CHARS = 1500, 600_000, 20_000
#: Rows ranked per language, as a multiple of SAMPLE_ROWS: a cut-off on the hash leaves about so many.
SPARE = 2
#: Sentences each worker remembers with their verdict; people repeat themselves.
CACHE = 100_000
DICT_BYTES = 32_768
#: Word statistics for the dictionaries: sentences a word must occur in, share of a sentence's words that must be
#: known and most frequent under the sentence's label.
MIN_TOKEN_SENTENCES, OWNED_SHARE = 5, 0.6
LEVEL = 1
#: A sentence needs so many letters (CJK characters count twice) and this margin to have a language. Neighbouring
#: shorter sentences of one turn are judged together, as soon as they have so many letters between them.
MIN_LETTERS, MIN_MARGIN_BYTES, MIN_MARGIN = 12, 3, 0.08
#: Largest share of its bytes that an accepted sentence compresses to.
MAX_RATIO = 0.75
#: Runs of words longer than this without a sentence end are judged in windows of WINDOW words.
LONG_WORDS, WINDOW = 24, 8

_SENTENCE = re.compile(r"(?<=[.?!…])[\"'”’»)*_\]]*\s+|(?<=[。？！])[”」』]*|[\n\r ]+")
_NOT_TEXT = re.compile(r"[\W\d_]+")
_MARKED = re.compile(r"[@\d]")
_ASCII_RUN = re.compile(r"[!-~]+")
_WORD = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_CJK = re.compile(r"[㐀-鿿]")
_CODES = {code: lang for lang, names in LANGUAGES.items() for code in (lang, *names)}


def label_language(label: str | None) -> str | None:
    """Language code a label names, None for a missing label, ``other`` for one outside LANGUAGES."""
    low = (label or "").strip().lower()
    if low in NO_LABEL:
        return None
    return _CODES.get(low) or _CODES.get(re.split(r"[-_ ]", low)[0], "other")


def sentences(text: str) -> list[str]:
    """Sentences, split at end marks and line breaks; text without marks for LONG_WORDS words in word windows."""
    out = []
    for s in (p.strip() for p in _SENTENCE.split(text)):
        if len(s) > 4 * LONG_WORDS and len(w := s.split()) > LONG_WORDS:
            out += [" ".join(w[i : i + WINDOW]) for i in range(0, len(w) - len(w) % WINDOW, WINDOW)]
            if tail := w[len(w) - len(w) % WINDOW :]:
                out.append(" ".join(tail))
        elif s:
            out.append(s)
    return out


def plain(sentence: str) -> str:
    """Letters only, lower-cased, one blank between words; addresses, numbers and codes are left out whole."""
    low = sentence.lower()
    if _MARKED.search(low):
        low = _ASCII_RUN.sub(lambda m: " " if _MARKED.search(m.group()) else m.group(), low)
    return _NOT_TEXT.sub(" ", low).strip()


def script(text: str) -> str:
    """Dominant script of a plain sentence: han, cyrl or latn."""
    n = len(text)
    if text.isascii():
        return "latn"
    if len(_CJK.findall(text)) * 2 > n:
        return "han"
    return "cyrl" if len(_CYRILLIC.findall(text)) * 2 > n else "latn"


def _tokens(text: str) -> list[str]:
    return list(text.replace(" ", "")) if script(text) == "han" else text.split()


def fit(rows: Iterable[tuple[str | None, list[str]]]) -> dict:
    """Model from labelled rows (label, texts): dictionary bytes and scripts per language."""
    by: dict[str, dict[str, None]] = defaultdict(dict)
    used: Counter = Counter()
    for label, texts in rows:
        lang = label_language(label)
        if lang is None or lang == "other":
            continue
        for text in texts:
            for s in sentences(text or ""):
                p = plain(s)
                if len(p) >= MIN_LETTERS and used[lang] < SAMPLE_CHARS and p not in by[lang]:
                    by[lang][p] = None
                    used[lang] += len(p)
    counts = {lang: Counter(t for s in ss for t in set(_tokens(s))) for lang, ss in by.items()}
    totals = {lang: len(ss) + 1.0 for lang, ss in by.items()}
    seen = sum(counts.values(), Counter())
    rate = {t: {k: (c[t] + 0.01) / totals[k] for k, c in counts.items()} for t, n in seen.items() if n >= MIN_TOKEN_SENTENCES}
    owner = {t: max(r, key=r.get) for t, r in rate.items()}

    def agreed(lang: str, s: str) -> bool:
        toks = _tokens(s)
        known = [t for t in toks if t in rate]
        if len(known) < OWNED_SHARE * len(toks) or sum(owner[t] == lang for t in known) < OWNED_SHARE * len(toks):
            return False
        score = {k: sum(math.log(rate[t][k]) for t in known) for k in counts}
        return all(score[lang] >= score[k] + 3 for k in score if k != lang)

    model: dict = {"dicts": {}, "scripts": {}}
    for lang, ss in by.items():
        chosen, size, kinds = [], 0, Counter()
        for s in ss:
            if size < DICT_BYTES and agreed(lang, s):
                chosen.append(s)
                size += len(s.encode()) + 1
                kinds[script(s)] += 1
        if chosen:
            model["dicts"][lang] = "\n".join(chosen).encode()[:DICT_BYTES]
            model["scripts"][lang] = [k for k, n in kinds.items() if n * 50 >= len(chosen)]
    model["order"] = [lang for lang, _ in used.most_common() if lang in model["dicts"]]
    return model


class Classifier:
    """Sentence classifier of a fitted model; made once per Python worker."""

    def __init__(self, model: dict):
        import zstandard as zs

        self.by_script, self.packers = defaultdict(list), {}
        self.judged = lru_cache(CACHE)(self._judge)
        for lang in model["order"]:
            d = zs.ZstdCompressionDict(model["dicts"][lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.packers[lang] = zs.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            for kind in model["scripts"][lang]:
                self.by_script[kind].append(lang)

    def sentence(self, text: str) -> tuple[str | None, float, int]:
        """(language or None, confidence, letters) of one sentence: every dictionary of its script is tried."""
        return self.judged(plain(text))

    def _judge(self, p: str) -> tuple[str | None, float, int]:
        kind = script(p)
        weight = len(p) * (2 if kind == "han" else 1)
        langs = self.by_script.get(kind, [])
        if weight < MIN_LETTERS or not langs:
            return None, 0.0, weight
        raw = p.encode()
        sizes = sorted((len(self.packers[k].compress(raw)), k) for k in langs)
        best, lang = sizes[0]
        gap = (sizes[1][0] - best) if len(sizes) > 1 else len(raw)
        confidence = 1.0 / sum(2.0 ** (best - s) for s, _ in sizes)
        if gap < max(MIN_MARGIN_BYTES, MIN_MARGIN * len(raw)) or best > MAX_RATIO * len(raw):
            return None, confidence, weight
        return lang, confidence, weight

    def _units(self, text: str) -> list[tuple[int, str | None, float, int]]:
        """(sentences, language, confidence, letters): sentences, neighbouring short ones judged together."""
        out, short = [], []
        for s in sentences(text):
            lang, conf, n = self.sentence(s)
            if n >= MIN_LETTERS:
                out += [(1, None, 0.0, 0) for _ in short]
                short = []
                out.append((1, lang, conf, n))
                continue
            short.append(s)
            lang, conf, n = self.sentence(" ".join(short)) if len(short) > 1 else (None, 0.0, n)
            if n >= MIN_LETTERS:
                out.append((len(short), lang, conf, n))
                short = []
        return out + [(1, None, 0.0, 0) for _ in short]

    def segments(self, texts: list[str | None]) -> list[tuple[int, int, int, str | None, float, int]]:
        """(turn, first sentence, sentences, language, confidence, letters): maximal runs of one language.

        Rejected sentences join the run before them; a text with no accepted sentence is one run without language.
        """
        out: list[list] = []
        for turn, text in enumerate(texts):
            run, at = None, 0
            for some, lang, conf, n in self._units(text or ""):
                if run is not None and (lang is None or run[3] is None or lang == run[3]):
                    run[2] += some
                    if lang is not None:
                        run[3] = lang
                        run[4] += conf * n
                        run[5] += n
                else:
                    run = [turn, at, some, lang, conf * n if lang else 0.0, n if lang else 0]
                    out.append(run)
                at += some
            if run is not None and run[1] == 0 and run[3] is None:  # no sentence of its own: the turn as a whole
                lang, conf, n = self.sentence(text or "")
                if lang is not None:
                    run[3:] = [lang, conf * n, n]
        return [(t, a, n, lang, w / c if c else 0.0, c) for t, a, n, lang, w, c in out]


def labelled_sample(df: DataFrame) -> list[tuple[str | None, list[str]]]:
    """At most SAMPLE_ROWS labelled rows per language, those with the smallest hash of their id, clipped to ROW_CHARS
    characters each and SAMPLE_CHARS together; the only rows the driver sees.

    Languages are counted first; a cut-off on the hash then leaves about SPARE * SAMPLE_ROWS rows of each to rank, so
    a language that labels most of the table is never sorted.
    """
    code = F.lower(F.trim(F.split("lang_label", "[-_ ]")[0]))
    known = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    named = df.withColumn("code", F.try_element_at(known, code)).where(F.col("code").isNotNull())
    counts = named.groupBy("code").agg(F.count("*").alias("n")).collect()  # one row per language
    span = float(2**64)
    limit = F.lit(None).cast("double")
    for r in counts:
        limit = F.when(F.col("code") == r["code"], F.lit(min(1.0, SPARE * SAMPLE_ROWS / r["n"]) * span - span / 2)).otherwise(limit)
    h = F.xxhash64("rec_id")
    near = named.where(h.cast("double") <= limit).select("rec_id", "code", h.alias("h"))
    order = Window.partitionBy("code").orderBy("h", "rec_id")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_ROWS).select("rec_id", "code", "h")
    clipped = F.substring(F.array_join("texts", "\n", ""), 1, ROW_CHARS)
    texts = user_texts(df).join(F.broadcast(chosen), "rec_id").select("rec_id", "code", "h", "lang_label", clipped.alias("text"))
    before = F.coalesce(F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = texts.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).orderBy("h", "rec_id")
    return [(r["lang_label"], [r["text"]]) for r in used.select("lang_label", "text", "h", "rec_id").collect()]


def user_texts(df: DataFrame) -> DataFrame:
    return df.select(
        "rec_id", "lang_label",
        F.transform(F.filter("conversation", lambda t: t["role"] == "user"), lambda t: t["content"]).alias("texts"),
    )


SEGMENTS = "rec_id bigint, label string, segments array<struct<turn:int,sentence:int,sentences:int,lang:string,confidence:double,letters:int>>"


def _classify(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model)
        kind = pa.list_(pa.struct([("turn", pa.int32()), ("sentence", pa.int32()), ("sentences", pa.int32()),
                                   ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())]))
        names = ("turn", "sentence", "sentences", "lang", "confidence", "letters")
        for batch in batches:
            labels = [label_language(x) for x in batch.column("lang_label").to_pylist()]
            found = [[dict(zip(names, s)) for s in classifier.segments(t or [])] for t in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rec_id"), pa.array(labels, pa.string()), pa.array(found, kind)], ["rec_id", "label", "segments"]
            )

    return run


def row_segments(df: DataFrame, model: dict | None = None) -> DataFrame:
    """(rec_id, label, segments) of every row: its label's language and the language runs of its user turns.

    ``turn`` counts user turns. NULL or empty conversations have no segments; without a fitted language every
    segment is without language. No shuffle: one pass over the rows.
    """
    model = model or fit(labelled_sample(df))
    return user_texts(df).mapInArrow(_classify(model), SEGMENTS)


def row_languages(segments: DataFrame) -> DataFrame:
    """(rec_id, label, lang, confidence, letters): one row per row and language with at least one whole sentence."""
    one = segments.select("rec_id", "label", F.explode("segments").alias("s")).where(F.col("s.lang").isNotNull())
    weight = F.sum("s.letters")
    return one.groupBy("rec_id", "label", F.col("s.lang").alias("lang")).agg(
        (F.sum(F.col("s.confidence") * F.col("s.letters")) / weight).alias("confidence"), weight.alias("letters")
    )


def label_cases(df: DataFrame) -> DataFrame:
    """(rec_id, lang): rows whose label is missing, names another language, or that mix languages."""
    langs = F.array_distinct(F.filter(F.transform("segments", lambda s: s["lang"]), lambda x: x.isNotNull()))
    rows = row_segments(df).select("rec_id", "label", langs.alias("langs"))
    case = F.col("label").isNull() | (F.size("langs") > 1) | ((F.size("langs") == 1) & (F.col("langs")[0] != F.col("label")))
    return rows.where(case).select("rec_id", F.explode("langs").alias("lang"))
