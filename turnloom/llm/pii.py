"""Problem 1: personal information inside free text.

Regular expressions propose spans, checksum validators (Luhn, mod-97) and the words around a span adjust its
score, spans at THRESHOLD or more are items. Items are replaced by typed placeholders; everything else of the
text stays as it is. One pass over the rows, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds and their placeholders.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
THRESHOLD = 1.0
#: The name list is held by every worker; a longer list than this is refused (about 100 bytes a name).
MAX_NAMES = 1_000_000
CONTEXT = 48
#: What a checksum adds to a score where it confirms a number, and takes off where it fails.
CONFIRMED, FAILED = 0.6, 0.4
#: What a long account-like code (18 characters or more, mostly digits) gets for its shape.
ACCOUNT_LIKE = 0.3

# Words near a span that speak for a kind (looked for just before it).
PHONE_WORDS = r"tel|telephone|phone|mobile|cell|fax|whatsapp|call|text me(?: on)?|my number is|n[úu]mero es|num[ée]ro est|nummer ist|il mio numero|meu n[úu]mero|mijn nummer|номер|电话"
ID_WORDS = (
    r"ssn|social security(?: number)?|tax (?:number|id|no\.?)|passport(?: (?:no\.?|number))?|national id|id card|identity card|"
    r"driv(?:ing|er'?s) licen[cs]e|licen[cs]e(?: no\.?)?|(?:credit |debit |payment )?card|iban|account(?: number)?|personnummer|nif|dni|"
    r"steuernummer|num[ée]ro de s[ée]curit[ée] sociale|codice fiscale"
)
FORM_WORDS = r"form use|asked for it|registered under|formular steht|formulario pone|formulaire indique|ref|it is registered"
ADDRESS_WORDS = r"live at|deliver it to|parcel went to|wohne(?: hier)?|vivo(?: aqu[íi])?|habite(?: ici)?|abito|moro|woon|address|adresse|to"
ECHO_WORDS = r"i noted|i will use|to confirm"
NAME_WORDS = (
    r"my name is|name is|sign it with|signed by|letter is for|got this from|regards|sincerely|m[’']appelle|me llamo|ich hei(?:ß|ss)e|mi chiamo|"
    r"me chamo|ik heet|meu nome [ée]|carta es para|carta [ée] para|brief ist f[üu]r|lettre est pour|lettera [èe] per|brief is voor|firmado por|dear"
)
TITLES = r"mr|mrs|ms|miss|dr|prof|herr|frau|mme|monsieur|madame|sr|sra|señor|señora"
NOT_NUMBERS = r"order|lot|ticket|hash|version|build|release|isbn|invoice|total|sums to|port|line|model|case|fall|dossier|expediente|processo|pratica"
STREET_EN = r"street|st|road|rd|avenue|ave|lane|ln|court|ct|close|rise|boulevard|blvd|drive|way|place|square|terrace|crescent|hill|grove|mews|row"
STREET_FR = r"rue|avenue|boulevard|chemin|impasse|quai|all[ée]e"
STREET_STEMS = r"stra(?:ß|ss)e|str\.|gasse|allee|platz|straat|laan|gracht|plein"
STREET_KINDS = r"calle|avenida|av\.|paseo|plaza|rua|travessa|via|viale|piazza|corso"
STOP = frozenset(
    "the a an of and or in on at to for from by with is are was were be been this that these those it its as if not no yes they them he she we you i my your "
    "his her our their old new please then yesterday today tomorrow call text send who what when where why how which all any some into over under".split()
)

_S = r"\s"
_DOT = rf"(?:\.|{_S}*[\[({{]{_S}*dot{_S}*[\])}}]{_S}*|{_S}+dot{_S}+)"
_EMAIL = re.compile(rf"(?<![\w.+%-])\w[\w.+%-]*(?:@|{_S}*[\[({{]{_S}*at{_S}*[\])}}]{_S}*)(?P<domain>[\w-]+(?:{_DOT}[\w-]+)+)", re.I)
_EMAIL_SPELLED = re.compile(rf"(?<![\w.+%-])\w[\w.+%-]*{_S}+at{_S}+(?P<domain>[\w-]+(?:{_S}+dot{_S}+[\w-]+)+)", re.I)
_DOT_WORD = re.compile(rf"[\[({{]{_S}*dot{_S}*[\])}}]|{_S}dot{_S}", re.I)
_NUMBER = re.compile(r"(?<![\w@.,/-])[+(]?\d(?:[\d().]|(?:[^\S\n]{1,3}|[-/])(?=[\d(])){5,26}\d(?![\w@]|[.,/-]\d)")
_SHAPES = {  # (kind, score without any context)
    "iban": (re.compile(rf"(?<!\w)[A-Z]{{2}}{_S}?\d{{2}}(?:{_S}?[A-Z\d]{{4}}){{3,7}}(?:{_S}?[A-Z\d]{{1,3}})?(?!\w)", re.I), 0.8),
    "licence": (re.compile(r"(?<!\w)[A-Z]\d{3}[- ]\d{4}[- ]\d{4}(?!\w)", re.I), 1.0),
    "id_card": (re.compile(r"(?<!\w)[A-Z]{2}\d{6}[A-Z](?!\w)", re.I), 1.0),
}
_ID_CUED = re.compile(rf"(?<!\w)(?:{ID_WORDS})(?:{_S}*(?:no\.?|number|nr\.?|is|:|#|-))*{_S}*(?P<v>[A-Z]{{0,3}}{_S}?\d[\dA-Z](?:[\dA-Z]|[ \-/.](?=[\dA-Z]*\d)){{4,28}})(?!\w)", re.I)
_STREET_EN = re.compile(
    rf"(?<![\w.,/-])(?:(?:flat|apt\.?|unit){_S}*\d+\w?,{_S}*)?\d{{1,5}}[a-z]?,?{_S}+(?P<words>(?:[^\W\d_][\w'’-]*{_S}+){{1,3}})(?:{STREET_EN})(?!\w)\.?"
    rf"(?P<tail>{_S}*,?{_S}*(?:apt\.?|flat|unit){_S}*\d+{_S}?[a-z]?)?(?P<code>,?{_S}*(?:[^\W\d_][\w'’-]*{_S}+){{1,2}}\d{{5}}(?!\d))?", re.I)
_STREET_DE = re.compile(rf"(?<!\w)[^\W\d_][\w-]{{0,60}}(?:{STREET_STEMS}){_S}+\d{{1,4}}{_S}?[a-z]?(?!\w)(?:,?{_S}*\d{{4,5}}{_S}+[^\W\d_]+)?", re.I)
_STREET_FR = re.compile(
    rf"(?<![\w.,/-])\d{{1,4}}(?:{_S}?(?:bis|ter|quater))?,?{_S}+(?:{STREET_FR}){_S}+(?:d[eu]s?{_S}+(?:la{_S}+)?|de{_S}+l['’]|l[ae]s?{_S}+)?[^\W\d_][\w'’-]*(?:,?{_S}*\d{{5}}{_S}+[^\W\d_]+)?", re.I)
_STREET_ES = re.compile(
    rf"(?<!\w)(?P<kind>{STREET_KINDS}){_S}+(?P<words>(?:[^\W\d_][\w'’-]*{_S}+){{0,3}}[^\W\d_][\w'’-]*),?{_S}+(?:n[º.]?{_S}*)?\d{{1,4}}(?![\w])(?:,{_S}*\d+\.?[ºª]?{_S}*[A-Z](?!\w))?(?:,{_S}*\d{{5}}{_S}+[^\W\d_]+)?", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """Luhn check of a digit string; '' and all zeros fail."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return bool(digits.strip("0")) and total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 mod-97 check of an account code such as an IBAN."""
    code = code.upper()
    return len(code) > 4 and code.isalnum() and code.isascii() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def checksum(code: str) -> int:
    """1 where the checksum that a code's shape calls for confirms it, -1 where it fails, 0 where the shape has none.

    Shapes: 13 to 19 digits (payment card, Luhn), two letters and two digits before 11 or more others (account, mod-97).
    """
    if code.isascii() and code.isdigit() and 13 <= len(code) <= 19:
        return 1 if luhn(code) else -1
    if len(code) >= 15 and code.isascii() and code.isalnum() and code[:2].isalpha() and code[2:4].isdigit():
        return 1 if mod97(code) else -1
    return 0


def checked(code: str) -> float:
    """What a code's checksum does to its score."""
    return {1: CONFIRMED, -1: -FAILED, 0: 0.0}[checksum(code)]


_near = {
    "phone": re.compile(rf"(?<!\w)(?:{PHONE_WORDS})\W*$", re.I),
    "id": re.compile(rf"(?<!\w)(?:{ID_WORDS})\W*(?:no\.?|number)?\W*$", re.I),
    "form": re.compile(rf"(?<!\w)(?:{FORM_WORDS})\W*(?:\w+\W+){{0,3}}$", re.I),
    "address": re.compile(rf"(?<!\w)(?:{ADDRESS_WORDS}|{ECHO_WORDS})\W*$", re.I),
    "echo": re.compile(rf"(?<!\w)(?:{ECHO_WORDS})\W*$", re.I),
    "not": re.compile(rf"(?<!\w)(?:{NOT_NUMBERS})\W*$", re.I),
}
_CUE = re.compile(rf"(?<!\w)(?:(?P<cue>{NAME_WORDS})|(?P<echo>{ECHO_WORDS}))\W*(?=\w)", re.I)
_TITLE = re.compile(rf"(?<!\w)(?:{TITLES})\.?{_S}+(?=[^\W\d_])", re.I)
_TITLES = frozenset(TITLES.split("|"))
_ARTICLES = frozenset(("the", "old", "a", "an", "quote", "plot"))
_AT = re.compile(rf"@|[\[({{]{_S}*at{_S}*[\])}}]", re.I)
_STEMS = re.compile(STREET_STEMS, re.I)
_KINDS = re.compile(rf"(?<!\w)(?:{STREET_KINDS})\s", re.I)
_CLOSED = re.compile(r"\s*(?:[.,;!?|\"}<)\]\n]|$|yesterday|then|for you|ok)", re.I)
_INITIAL = re.compile(r"\.?\s+")
_COMMA = re.compile(r",\s*")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d")
_PHONE_SHAPES = re.compile(
    r"\+\d[\d ().\-]{7,20}|00\d[\d ().\-]{7,20}|\(\d{2,5}\) ?\d{3,4}[ .\-]?\d{3,5}|\d{3}([ .\-])\d{3}\1\d{4}|0\d{9,10}|0\d{2,4} \d{3,4} \d{3,4}|0\d(?: \d\d){4}"
)
# What a text with an item of digits holds: five digits as near as in a number or cued id, the tail of a short account
# code, or a house number before a street word.
_DIGITS = re.compile(
    rf"\d(?:\D{{0,80}}\d){{4}}|\d\d(?:{_S}?[A-Z\d]{{4}}){{3}}|\d[\w,.]*{_S}+(?:[\w.,’'-]+{_S}+){{0,3}}(?:{STREET_EN}|{STREET_FR})(?!\w)", re.I)
#: Letters whose lower case is not what re.I or a single word's lower() takes for it; texts with one are always searched.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u03a3]")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def spellings(pattern: str) -> list[str]:
    """Every string that a finite pattern (literals, sets, groups, alternatives, optional parts) matches."""
    from re import _constants as K
    from re import _parser

    def each(nodes) -> list[str]:
        out = [""]
        for op, arg in nodes:
            if op is K.LITERAL:
                ends = [chr(arg)]
            elif op is K.IN:
                ends = [x for node in arg for x in each([node])]
            elif op is K.BRANCH:
                ends = [x for branch in arg[1] for x in each(branch)]
            elif op is K.SUBPATTERN:
                ends = each(arg[3])
            elif op is K.MAX_REPEAT and arg[:2] == (0, 1):
                ends = ["", *each(arg[2])]
            else:
                raise ValueError(f"not a finite pattern: {pattern}")
            out = [a + b for a in out for b in ends]
        return out

    return each(_parser.parse(pattern))


class Finder:
    """Finds items in one text; made once per worker."""

    def __init__(self, given: set[str], family: set[str]):
        import ahocorasick

        self.given, self.family = given, family
        # cheap test of whether a text can hold an item at all, on blank-collapsed lower case: what every pattern needs,
        # as (length, starts a word, what has to follow: nothing, a digit, or the end of the word)
        self.triggers = ahocorasick.Automaton()
        signs = ["@", " dot ", *(f"{a}{b}at{c}{d}" for a in "[({" for b in ("", " ") for c in ("", " ") for d in "])}")]
        needs = [(w, False, None) for w in (*given, *family, *signs)]
        needs += [(w, True, "end") for words in (NAME_WORDS, ECHO_WORDS) for w in spellings(words)]
        needs += [(w + end, True, None) for w in spellings(TITLES) for end in (" ", ". ")]
        needs += [(w + " ", True, None) for w in spellings(STREET_KINDS)] + [(w + " ", False, "digit") for w in spellings(STREET_STEMS)]
        kinds: dict[str, set] = {}
        for w, starts, follows in needs:
            kinds.setdefault(w, set()).add((len(w), starts, follows))
        for w, checks in kinds.items():
            self.triggers.add_word(w, tuple(checks))
        self.triggers.make_automaton()

    def may_hold(self, text: str) -> bool:
        if _DIGITS.search(text) or _ODD_CASE.search(text):
            return True
        low = " ".join(text.lower().split())
        for end, checks in self.triggers.iter(low):
            after = low[end + 1 : end + 2]
            for length, starts, follows in checks:
                if starts and end >= length and _is_word(low[end - length]):
                    continue
                if follows is None or (after.isdecimal() if follows == "digit" else after and not _is_word(after)):
                    return True
        return False

    def items(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the items of a text, not overlapping, in order. NULL and '' have none."""
        if not text or not self.may_hold(text):
            return []
        found = [*self._emails(text), *self._ids(text), *self._numbers(text), *self._addresses(text)]
        mails = [(s, e) for s, e, kind, _ in found if kind == "email"]
        found += [x for x in self._names(text) if not any(s < x[1] and x[0] < e for s, e in mails)]
        taken: list[tuple[int, int, str]] = []
        for s, e, kind, score in sorted(found, key=lambda x: (-x[3], x[0] - x[1])):
            if score >= THRESHOLD and not any(a < e and s < b for a, b, _ in taken):
                taken.append((s, e, kind))
        return sorted(taken)

    def redact(self, text: str | None) -> str | None:
        if text is None:
            return None
        for s, e, kind in reversed(self.items(text)):
            text = text[:s] + PLACEHOLDERS[kind] + text[e:]
        return text

    def _emails(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for pattern, needs in ((_EMAIL, _AT), (_EMAIL_SPELLED, _DOT_WORD)):
            for m in pattern.finditer(text) if needs.search(text) else ():
                labels = [x for x in re.split(r"[\W_]+", m["domain"].lower()) if x]
                spelled = pattern is _EMAIL_SPELLED and any(x in STOP for x in labels)
                if len(labels[-1]) >= 2 and labels[-1].isalpha() and not spelled:
                    yield m.start(), m.end(), "email", 2.0

    def _ids(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for m in _ID_CUED.finditer(text):
            v = m["v"]
            digits = sum(c.isdigit() for c in v)
            if digits >= 5 and not _DATE.fullmatch(v):
                yield m.start("v"), m.end("v"), "id_number", 1.5 + checked(re.sub(r"\W", "", v))
        for name, (shape, base) in _SHAPES.items():
            for m in shape.finditer(text):
                before = text[max(0, m.start() - CONTEXT) : m.start()]
                code = re.sub(r"\W", "", m.group())
                score = base + 0.6 * bool(_near["form"].search(before) or _near["echo"].search(before) or _near["id"].search(before))
                if name == "iban":
                    share = sum(c.isdigit() for c in code) / len(code)
                    score += checked(code) + (ACCOUNT_LIKE if share > 0.7 and len(code) >= 18 else -0.8)
                if _near["not"].search(before):
                    score -= 1
                yield m.start(), m.end(), "id_number", score

    def _numbers(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for m in _NUMBER.finditer(text):
            span = m.group()
            digits = "".join(c for c in span if c.isdigit())
            before = text[max(0, m.start() - CONTEXT) : m.start()]
            if not 7 <= len(digits) <= 19 or _DATE.fullmatch(span) or _near["not"].search(before) or "," in span:
                continue
            flat = " ".join(span.split())
            phone_cue, id_cue, form = (bool(_near[k].search(before)) for k in ("phone", "id", "form"))
            echo = bool(_near["echo"].search(before))
            ident = 0.0
            if re.fullmatch(r"\d{3}[- ]\d\d[- ]\d{4}", flat):
                ident = 1.0
            elif re.fullmatch(r"\d{6}[-+]\d{4}", flat):
                ident = 0.6 + 0.5 * luhn(digits)
            elif re.fullmatch(r"\d\d/\d{3}/\d{5}", flat):
                ident = 0.8
            elif re.fullmatch(r"(?:\d{4}[ -]?){3}\d{1,7}", flat) and len(digits) >= 13:
                ident = 0.8 + checked(digits)
            elif len(digits) == 9 and flat.isdigit():
                ident = 0.3
            phone = 0.0
            if 8 <= len(digits) <= 15:
                phone = 1.1 if _PHONE_SHAPES.fullmatch(flat.strip()) else 0.2
            if id_cue:
                yield m.start(), m.end(), "id_number", 1.6 + checked(digits)
            elif phone_cue and len(digits) <= 15:
                yield m.start(), m.end(), "phone", max(phone, 0.5) + 0.8
            else:
                ident += 0.7 * form * (ident > 0) + 0.4 * echo * (ident > 0)
                yield (m.start(), m.end(), "id_number", ident) if ident >= phone else (m.start(), m.end(), "phone", phone)

    def _addresses(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for pattern, checked, needs in ((_STREET_EN, True, None), (_STREET_ES, True, _KINDS), (_STREET_DE, False, _STEMS), (_STREET_FR, False, None)):
            for m in pattern.finditer(text) if needs is None or needs.search(text) else ():
                score = 1.2
                if checked:
                    words = m["words"].split()
                    before = text[max(0, m.start() - CONTEXT) : m.start()]
                    cue = bool(_near["address"].search(before)) or bool(m.groupdict().get("tail")) or bool(m.groupdict().get("code"))
                    titled = all(w[:1].isupper() for w in words) and ("kind" not in m.groupdict() or m["kind"][:1].isupper())
                    shouting = m.group().isupper() and text[max(0, m.start() - 30) : m.start()].isupper()
                    score = (0.8 if titled and not shouting else 0.3) + 0.8 * cue - 1.0 * any(w.lower() in STOP - {"old", "new"} for w in words)
                    score += 0.3 * (titled and not shouting)
                yield m.start(), m.end(), "address", score

    def _names(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
        low = [w[2].lower() for w in words]
        cues = {m.end(): "cue" if m["cue"] else "echo" for m in _CUE.finditer(text)}
        titles = {m.end(): m.start() for m in _TITLE.finditer(text)}
        for i in range(len(words) - 1):
            start, end, first = words[i]
            a, j = low[i], i + 1
            if len(low[j]) == 1 and j + 1 < len(words) and _INITIAL.fullmatch(text, words[j][1], words[j + 1][0]):
                j += 1  # a middle initial
            b = low[j]
            some = a in self.given or a in self.family or b in self.given or b in self.family
            title = titles.get(start)
            cue = cues.get(start if title is None else title)
            titled = first[:1].isupper() and words[j][2][:1].isupper()
            if not (some or cue or title is not None) or len(a) < 2 or len(b) < 2 or a in _TITLES:
                continue
            gap = text[end : words[i + 1][0]]
            comma = _COMMA.fullmatch(gap) is not None
            if not (gap.isspace() and gap.count("\n") < 2 or comma):
                continue
            last = words[j][1]
            if (a in self.given and b in self.family) or (a in self.family and b in self.given):
                yield start, last, "name", 1.5
                continue
            if a in STOP or b in STOP or not (cue or title is not None or titled) or (comma and not (cue and (some or titled))):
                continue
            before = text[max(0, start - CONTEXT) : start]
            shouting = (first + words[j][2]).isupper() and len(before) > 20 and before.isupper()
            closed = _CLOSED.match(text, last) is not None
            article = i > 0 and low[i - 1] in _ARTICLES
            score = 0.6 * some + 0.5 * titled + 0.7 * (cue == "cue") + 0.5 * (title is not None) + 0.3 * closed
            score += 0.3 * (cue == "echo") * (some or titled) - 0.8 * (shouting and not cue) - 0.8 * article
            if cue == "echo" and not some and not (titled and closed):
                score -= 1
            yield start, last, "name", score


def name_sets(names: DataFrame) -> tuple[set[str], set[str]]:
    """Given and family names of name_list(name, kind), lower-cased; NULL and blank names are left out."""
    rows = names.where(F.trim("name") != "").select(F.lower(F.trim("name")).alias("n"), "kind").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the name list holds more than MAX_NAMES = {MAX_NAMES} names")
    return {r["n"] for r in rows if r["kind"] == "given"}, {r["n"] for r in rows if r["kind"] == "family"}


def _finding(names: tuple[set[str], set[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*names)
        for batch in batches:
            ids, turns, kinds = [], [], []
            for rec, texts in zip(batch.column("rec_id").to_pylist(), batch.column("texts").to_pylist()):
                for turn, text in enumerate(texts or []):
                    for kind in sorted({k for _, _, k in finder.items(text)}):
                        ids.append(rec)
                        turns.append(turn)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(turns, pa.int32()), pa.array(kinds, pa.string())], ["rec_id", "turn", "kind"])

    return run


def _slim(df: DataFrame) -> DataFrame:
    return df.select("rec_id", F.transform("conversation", lambda t: t["content"]).alias("texts"))


def found_kinds(df: DataFrame, names: DataFrame) -> DataFrame:
    """(rec_id, turn, kind): one row per row, turn and kind of item. NULL conversations and contents hold none."""
    return _slim(df).mapInArrow(_finding(name_sets(names)), "rec_id bigint, turn int, kind string")


def redacted(df: DataFrame, names: DataFrame) -> DataFrame:
    """``df`` with every item of ``conversation`` replaced by its placeholder; all other columns are kept."""
    sets = name_sets(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*sets)
        for batch in batches:
            at = batch.schema.get_field_index("conversation")
            turns = [c and [t and {**t, "content": finder.redact(t["content"])} for t in c] for c in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(turns, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
