"""Problem 10: garbled text from wrong character encoding, by expectation-maximisation over encoding chains.

A link (true, read) means: bytes written in ``true`` were decoded as ``read``; a chain is one or more links, one
after another. Under every chain, the spans of a text that could be its result are undone, and character-pair counts
of the whole corpus say how much commoner the undone spelling is than the one found. That evidence is weak for a
single span; EM with the chain as latent variable estimates how frequent each chain is in a source and field, and
so pools it. A record is garbled where the posterior of "clean" falls below one half, and is repaired chain by
chain in the order of the posterior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage

# Links looked for, commonest first.
UTF8_READ_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15", "koi8_r", "cp866")
BYTES_READ_AS = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("gb18030", "cp1252"), ("cp1251", "mac_roman"), ("cp1251", "cp437"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp1251"),
)
LOSSY = "lossy"
LINKS = tuple(f"utf_8>{w}" for w in UTF8_READ_AS) + tuple(f"{a}>{b}" for a, b in BYTES_READ_AS)
#: Joins the links of a chain, the one to undo first in front.
THEN = " then "
#: A run of fewer high characters may well be right as it stands, so shorter ones under an 8-bit link count for and against it.
SURE = 4
#: From this gain on a short run counts by itself.
PLAIN_GAIN = 4.0
#: EM starts with this share of garbled records; it ends when that share moves by no more than TOLERANCE in any source,
#: or after EM_ROUNDS.
GARBLED, TOLERANCE, EM_ROUNDS = 0.02, 5e-4, 25
#: Priors (16 to 80 bytes each) that are broadcast.
BROADCAST_PRIORS = 200_000
#: A chain of one more link is so much rarer at first.
DEEPER = 0.1
CODES = 2048
#: Judged spans each worker remembers; words repeat, so most spans cost one look-up.
CACHE = 200_000


def _code(cp: int) -> int:
    """Character classes for the pair counts: single letters and punctuation, blocks for the rest."""
    if cp < 0x250:
        return cp
    if 0x400 <= cp < 0x460:
        return 600 + cp - 0x400
    if 0x2000 <= cp < 0x2070:
        return 700 + cp - 0x2000
    if 0x4E00 <= cp < 0xA000:
        return 1024 + cp % 1000
    if 0x3000 <= cp < 0x3100 or 0xFF00 <= cp < 0xFFF0:
        return 821
    if 0x20A0 <= cp < 0x20D0 or 0x2200 <= cp < 0x2300:
        return 822 + (cp & 0x7F)
    return 960 + (cp >> 8) % 63


@lru_cache(1)
def _lookup() -> np.ndarray:
    table = np.array([_code(cp) for cp in range(0x10000)], np.int64)
    return np.append(table, 1023)


def _codes(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _lookup()[np.minimum(cps, 0x10000)]


@lru_cache(64)
def _to_byte(codec: str) -> dict[str, int]:
    """Characters of an 8-bit codec to bytes; bytes without a character stand for the control of their number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


def _class(codec: str, low: int, high: int) -> str:
    return "[" + "".join(re.escape(ch) for ch, b in _to_byte(codec).items() if low <= b <= high) + "]"


@lru_cache(64)
def _finder(link: str) -> re.Pattern:
    true, read = link.split(">")
    if true == "utf_8":
        c = _class(read, 0x80, 0xBF)
        return re.compile(
            f"(?:{_class(read, 0xC2, 0xDF)}{c}|{_class(read, 0xE0, 0xEF)}{c}{{2}}|{_class(read, 0xF0, 0xF4)}{c}{{3}})+"
        )
    return re.compile(f"{_class(read, 0x80, 0xFF)}+")


def _undo(link: str, span: str) -> str | None:
    true, read = link.split(">")
    table = _to_byte(read)
    try:
        out = bytes(table[ch] for ch in span).decode(true)
    except UnicodeDecodeError:
        return None
    return None if "�" in out else out


def is_utf8(link: str) -> bool:
    return link.startswith("utf_8>")


class Span(NamedTuple):
    """A place of a run that a chain may have made: its ends, the undone text, and how much commoner that is."""

    chain: str
    start: int
    end: int
    undone: str
    gain: float


class PairModel:
    """Mean log frequency of character pairs over the corpus, and the gain of undoing a span."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        total = float(counts.sum()) + 1.0
        self.log = np.full(CODES * CODES, math.log(0.5 / total))
        self.log[pairs] = np.log((counts + 0.5) / total)
        self.floor = -math.log(total)
        self.spans = lru_cache(CACHE)(self._spans)

    def mean(self, text: str) -> float:
        codes = _codes(text)
        return float(self.log[codes[:-1] * CODES + codes[1:]].mean()) if len(codes) > 1 else self.floor

    def _spans(self, left: str, run: str, right: str) -> tuple[tuple[Span, ...], tuple[Span, ...]]:
        """Spans of a run of non-ASCII characters in its context of one character, under every chain: those that count by
        themselves, and the rest.

        Undoing UTF-8 shortens the text, and an 8-bit link ends a chain, so chains end by themselves. Of several chains
        from one first link to the same text the shortest counts, repeats of a link before others.
        """
        out: list[Span] = []
        for link in LINKS:
            for m in _finder(link).finditer(run):
                start, end = m.span()
                a, b = run[start - 1] if start else left, run[end] if end < len(run) else right
                found, seen = None, {m.group()}
                todo = [((link,), _undo(link, m.group()))]
                while todo:
                    chain, undone = todo.pop(0)
                    if undone is None or undone in seen:
                        continue
                    seen.add(undone)
                    found = self.mean(a + m.group() + b) if found is None else found
                    gain = (self.mean(a + undone + b) - found) * (len(undone) + 1)
                    plain = not is_utf8(link) and end - start < SURE
                    if plain and gain > 0:  # a capital is rare as such, so a short run has to gain without its case as well
                        low = [(a + x + b).lower() for x in (undone, m.group())]
                        gain = min(gain, (self.mean(low[0]) - self.mean(low[1])) * (len(undone) + 1))
                    if gain > 0 or plain:
                        out.append(Span(THEN.join(chain), start, end, undone, gain))
                    if undone.isascii() or not is_utf8(chain[-1]):
                        continue
                    for deeper in (chain[-1], *LINKS):
                        # the link before garbled the whole span, so the next one has to explain all of it as well
                        if (is_utf8(deeper) or len(undone) >= SURE) and _finder(deeper).sub("", undone).isascii():
                            todo.append(((*chain, deeper), _finder(deeper).sub(lambda x, k=deeper: _undo(k, x.group()) or x.group(), undone)))
        strong = lambda s: is_utf8(s.chain) or s.end - s.start >= SURE or s.gain >= PLAIN_GAIN
        return tuple(s for s in out if strong(s)), tuple(s for s in out if not strong(s))


_RUNS = re.compile(r"[^\x00-\x7f]+")


def all_spans(text: str, model: PairModel) -> dict[str, list[Span]]:
    """By chain, the spans of a text that speak for it, in order.

    Spans whose undoing gains count, each by itself. Runs of fewer than SURE characters under an 8-bit link, which may
    well be right as they stand, count by themselves from PLAIN_GAIN on; the rest of them only where they gain in sum.
    """
    out: dict[str, list[Span]] = {}
    weak: list[tuple[int, tuple[Span, ...]]] = []

    def add(at: int, s: Span) -> None:
        out.setdefault(s.chain, []).append(Span(s.chain, at + s.start, at + s.end, s.undone, s.gain))

    for run in _RUNS.finditer(text):
        at, end = run.span()
        strong, rest = model.spans(text[at - 1] if at else " ", run.group(), text[end] if end < len(text) else " ")
        for s in strong:
            add(at, s)
        if rest:
            weak.append((at, rest))
    if weak:
        sums: dict[str, float] = {}
        same = {id(rest): rest for _, rest in weak}
        for key, n in Counter(id(rest) for _, rest in weak).items():
            for s in same[key]:
                sums[s.chain] = sums.get(s.chain, 0.0) + n * s.gain
        gaining = {chain for chain, total in sums.items() if total > 0}
        for at, rest in weak if gaining else ():
            for s in rest:
                if s.chain in gaining:
                    add(at, s)
        for chain in gaining:
            out[chain].sort(key=lambda s: s.start)
    return out


def evidence(text: str, model: PairModel) -> dict[str, float]:
    """Total gain per chain; each U+FFFD counts as lossy evidence, which nothing can undo."""
    got = {chain: sum(s.gain for s in spans) for chain, spans in all_spans(text, model).items()}
    if n := text.count("\ufffd"):
        got[LOSSY] = 10.0 * n
    return got


def start_prior(chain: str) -> float:
    return GARBLED / (len(LINKS) + 1) * DEEPER ** chain.count(THEN)


def repair(text: str, model: PairModel, priors: dict[str, float]) -> str:
    """Undo the most probable chain, again and again, until nothing gains or a text comes up again."""
    seen = set()
    while text not in seen:
        seen.add(text)
        found = all_spans(text, model)
        if not found:
            break
        chain = max(sorted(found), key=lambda k: sum(s.gain for s in found[k]) + math.log(priors.get(k, start_prior(k))))
        for s in reversed(found[chain]):
            text = text[: s.start] + s.undone + text[s.end :]
    return text


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bins = np.zeros(CODES * CODES, np.int64)
    for batch in batches:
        column = batch.column("text")
        for text in column.filter(pc.invert(pc.fill_null(pc.string_is_ascii(column), True))).to_pylist():
            codes = _codes(text)
            keys, n = np.unique(codes[:-1] * CODES + codes[1:], return_counts=True)
            bins[keys] += n
    at = np.flatnonzero(bins)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bins[at])], ["pair", "n"])


def pair_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts): character pairs over every text with a non-ASCII character, as two arrays of at most CODES * CODES
    (2**22) numbers, so 48 MB whatever the corpus."""
    parts = docs.select("text").mapInArrow(_count_pairs, "pair bigint, n bigint")
    rows = parts.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    return rows["pair"].to_numpy(np.int32), rows["n"].to_numpy(np.int64)


EVIDENCE = "array<struct<chain:string,gain:double>>"


def _weigh(pairs: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairModel(*pairs)
        kind = pa.list_(pa.struct([("chain", pa.string()), ("gain", pa.float64())]))
        for batch in batches:
            column = batch.column("text")
            batch = batch.filter(pc.invert(pc.fill_null(pc.string_is_ascii(column), True)))
            found = [[{"chain": k, "gain": v} for k, v in evidence(t, model).items()] for t in batch.column("text").to_pylist()]
            out = pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "field", "source")] + [pa.array(found, kind)], ["doc_id", "field", "source", "evidence"])
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return run


def fields_of(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, field, source, text): one row per record and field. A NULL source is a source of its own."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields])).alias("f")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), each).select("doc_id", "f.field", "source", "f.text")


def _posterior(prior: Column, clean: Column, evidence: Column) -> Column:
    """STRUCT<clean, chains ARRAY<STRUCT<chain, p>>> of one record, by its source's priors (a map, and that of "clean")."""
    top = F.greatest(F.array_max(F.transform(evidence, lambda e: e["gain"])), F.lit(0.0))
    depth = lambda c: F.size(F.split(c, THEN)) - 1
    start = lambda c: F.lit(start_prior("")) * F.pow(F.lit(DEEPER), depth(c))

    def shares(m: Column) -> Column:
        each = F.transform(evidence, lambda e: F.struct(e["chain"].alias("chain"), (F.coalesce(F.try_element_at(prior, e["chain"]), start(e["chain"])) * F.exp(e["gain"] - m)).alias("w")))
        return F.struct((clean * F.exp(-m)).alias("c"), each.alias("w"))

    def normal(x: Column) -> Column:
        total = x["c"] + F.aggregate(x["w"], F.lit(0.0), lambda acc, e: acc + e["w"])
        return F.struct((x["c"] / total).alias("clean"), F.transform(x["w"], lambda e: F.struct(e["chain"].alias("chain"), (e["w"] / total).alias("p"))).alias("chains"))

    return T.let(T.let(top, shares), normal)


def _with_priors(weighed: DataFrame, priors: DataFrame, small: bool, row: Column) -> DataFrame:
    """Records joined to the priors of their (source, field), with the posterior: broadcast where the priors are known to
    be few, else shuffled with hot sources salted."""
    if small:
        joined = weighed.join(F.broadcast(priors), ["source", "field"])
    else:
        joined = join_counted(weighed, priors, ["source", "field"], "k", row, hot_threshold(priors, "k"))
    return joined.withColumn("post", _posterior(F.col("prior"), F.col("p_clean"), F.col("evidence")))


def _family(ms: Column) -> Column:
    """Each chain's expected records, and DEEPER of its first link's family as well for a chain of several links."""
    first = lambda c: F.element_at(F.split(c, THEN), 1)

    def pooled(e: Column) -> Column:
        kin = F.aggregate(F.filter(ms, lambda x: first(x["chain"]) == first(e["chain"])), F.lit(0.0), lambda acc, x: acc + x["m"])
        return F.struct(e["chain"].alias("chain"), (e["m"] + F.when(first(e["chain"]) == e["chain"], 0.0).otherwise(F.lit(DEEPER) * kin)).alias("m"))

    return F.transform(ms, pooled)


def chain_priors(stage: Stage, weighed: DataFrame, sizes: DataFrame) -> tuple[DataFrame, bool]:
    """(source, field, k, n, p_clean, prior MAP<chain, p>) by EM over all records with evidence, as distributed rounds; and
    whether these are at most BROADCAST_PRIORS numbers.

    ``sizes`` is (source, field, k, n): records with evidence and records in all. Records of equal evidence are
    combined first. One round is a map over them and one aggregation, combined map-side to one row per source, field
    and chain. One clean and one evenly garbled record are added, so that a source of few records keeps open priors,
    and a chain of several links borrows from those that begin alike.
    """
    none = F.create_map().cast("map<string,double>")
    equal = stage.write(weighed.groupBy("source", "field", "evidence").agg(F.count("*").alias("records")), "equal")
    priors = stage.write(sizes.select("*", F.lit(1.0 - GARBLED).alias("p_clean"), none.alias("prior")), "priors")
    pseudo = F.lit(start_prior("") / GARBLED) * F.pow(F.lit(DEEPER), F.size(F.split("chain", THEN)) - 1)
    small = priors.count() <= BROADCAST_PRIORS
    for _ in range(EM_ROUNDS):
        post = _with_priors(equal, priors, small, F.xxhash64("evidence"))
        shares = post.select("source", "field", "records", F.explode("post.chains").alias("c"))
        mass = shares.groupBy("source", "field", "c.chain").agg(F.sum(F.col("c.p") * F.col("records")).alias("m"))
        held = mass.groupBy("source", "field").agg(F.sum("m").alias("garbled"), F.collect_list(F.struct("chain", (F.col("m") + pseudo).alias("m"))).alias("ms"))
        old = priors.select("source", "field", "k", "n", F.col("p_clean").alias("before"))
        new = old.join(held, ["source", "field"], "left")
        total = F.col("n") + 2.0
        new = new.withColumn("p_clean", (F.col("n") - F.coalesce("garbled", F.lit(0.0)) + 1.0) / total)
        new = new.withColumn("prior", F.coalesce(F.map_from_entries(F.transform(_family(F.col("ms")), lambda e: F.struct(e["chain"], e["m"] / total))), none))
        before, priors = priors, stage.write(new.drop("garbled", "ms"), "priors")
        stage.drop(before)
        last = priors.agg(F.max(F.abs(F.col("p_clean") - F.col("before"))).alias("moved"), F.sum(F.size("prior") + 1).alias("numbers")).first()
        small = (last["numbers"] or 0) <= BROADCAST_PRIORS
        if (last["moved"] or 0.0) < TOLERANCE:
            break
    return priors.select("source", "field", "k", "n", "p_clean", "prior"), small


def posteriors(docs: DataFrame, fields: tuple[str, ...] = ("text",)) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(doc_id, field, prior, clean): every record with evidence, the priors of its source and field, and the posterior
    of "clean"; and the pair counts.

    Records without a non-ASCII character, NULL and empty texts have no evidence and do not appear.
    """
    stage = Stage(docs.sparkSession, "encoding")
    slim = fields_of(docs, fields)
    pairs = pair_counts(slim)
    weighed = stage.write(slim.mapInArrow(_weigh(pairs), f"doc_id bigint, field string, source string, evidence {EVIDENCE}"), "evidence")
    some = weighed.groupBy("source", "field").agg(F.count("*").alias("k"))
    sizes = stage.write(slim.groupBy("source", "field").agg(F.count("*").alias("n")).join(some, ["source", "field"]), "sizes")
    priors, small = chain_priors(stage, weighed, sizes)
    return _with_priors(weighed, priors, small, F.col("doc_id")).select("doc_id", "field", "prior", F.col("post.clean").alias("clean")), pairs


def garbled_documents(docs: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id) of the documents that hold the result of a wrong decoding in a field, restorable or not."""
    return posteriors(docs, fields)[0].where(F.col("clean") < 0.5).select("doc_id").distinct()


def _repairer(pairs: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PairModel(*pairs)
        for batch in batches:
            priors = [dict(p or ()) for p in batch.column("prior").to_pylist()]
            texts = [repair(t, model, p) for t, p in zip(batch.column("text").to_pylist(), priors)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("field"), pa.array(texts, pa.string()), pa.array(["\ufffd" not in t for t in texts])],
                ["doc_id", "field", "text", "restored"],
            )

    return run


def repaired_documents(docs: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, field, text, restored) of the garbled fields; ``restored`` is false where characters are lost."""
    found, pairs = posteriors(docs, fields)
    hit = fields_of(docs, fields).drop("source").join(found.where(F.col("clean") < 0.5), ["doc_id", "field"]).drop("clean")
    return hit.mapInArrow(_repairer(pairs), "doc_id bigint, field string, text string, restored boolean")
