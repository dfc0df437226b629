"""op2: personal data, plain and disguised, with spans in the source text.

The base kinds are found by their patterns.  Disguises are undone by transducers that write a
normalised text and keep, for each of its characters, the source span it came from:

1. homoglyphs, full-width forms and the decimal digits of every script become ASCII characters,
2. spelled digits ("four one five", "double one"; English, German, French, Spanish) become
   digits, and runs of them join,
3. "at" and "dot" in brackets, spaced out, joined by underscores, or in words (of the same languages) between
   host labels become ``@`` and ``.``.  A plain "at" is one only where what stands before it can be a name.

Identifiers are found in the normalised text by the same rules and mapped back; those that no
single base span covers whole are added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with the whole run of local characters before it and a dotted host after it.

    The same spans as the pattern's leftmost matches, but linear in the text's length.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = sum(_DOUBLED[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by the plain patterns; a match that fails its check is dropped."""
    out: list[Span] = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# Letters of other scripts, each before the ASCII letter that it looks like (a choice of this module).
_PAIRS = (
    # Cyrillic
    "аa сc еe оo рp хx уy іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl кk ԍg АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY ҮY ԚQ ԜW ӀI ԌG ѴV З3 б6 "
    # Greek
    "αa οo ρp νv ιi κk υu γy ηn ωw χx ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    # Armenian
    "օo ոn սu հh ցg զq յj ՕO ՍU ՏS ԼL "
    # Cherokee
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    # Latin
    "ıi ɑa ɡg ɩi ʏY ɴN ʜH ʟL ʙB ɪI ʀR ꜱS ᴀA ᴄC ᴅD ᴇE ᴊJ ᴋK ᴍM ᴏO ᴘP ᴛT ᴜU ᴠV ᴡW ᴢZ "
    # Marks
    "‐- ‑- ‒- –- −- ․. 。."
)
_LOOKS = {p[0]: p[1] for p in _PAIRS.split(" ")} | {"\u00a0": " ", "\u2007": " ", "\u202f": " "}
_NOTHING = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
#: Superscripts stand in plain prose (m\u00b2) and are no disguise.
_RAISED = frozenset("\u00b9\u00b2\u00b3\u2070\u2074\u2075\u2076\u2077\u2078\u2079\u00aa\u00ba")


@lru_cache(maxsize=1 << 16)
def look(ch: str) -> str:
    """The ASCII character that ``ch`` passes for (by the table, as a decimal digit, or by its
    compatibility form); itself if none."""
    if ch < "\x80" or ch in _RAISED:
        return ch
    if ch in _NOTHING:
        return ""
    if (plain := _LOOKS.get(ch)) is not None:
        return plain
    if (digit := unicodedata.decimal(ch, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", ch)
    return plain if len(plain) == 1 and "!" <= plain <= "~" else ch


# Digit names of the corpus's languages; those of the second row are words of other meaning too
# and count inside a run only.
_SPELLED = {
    **{w: str(k) for row in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro - deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    ) for k, w in enumerate(row.split())},
    "zwo": "2", "fuenf": "5",
}
_INSIDE = {"oh": "0", "o": "0", "ein": "1", "un": "1", "une": "1"}
_TIMES = {"double": 2, "doble": 2, "doppel": 2, "triple": 3}
_PLUS, _POINT = frozenset(["plus", "más", "mas"]), frozenset(["dot", "point", "punkt", "punto", "punkto"])
_NAMES = frozenset(_SPELLED) - {"-"}
#: What may stand at a word beside white space.
_AROUND = ",.;:!?()[]{}<>|/\\-–—\"'`“”„«»"


def has_name(text: str) -> bool:
    """Whether a digit's name stands in the text as a word."""
    text = text.lower()
    for c in _AROUND:
        if c in text:
            text = text.replace(c, " ")
    return not _NAMES.isdisjoint(text.split())


_SPOKEN_PART = re.compile(r"([^\W\d_]++)|([0-9]++)|([\s,.()/:-]++)|.", re.S)


def spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits that write runs of spelled digits as digits.

    A run has three items or more, two of them names; between items stand white space and marks,
    where a full stop, spelled or not, stays one."""
    edits: list[tuple[int, int, str]] = []
    parts: list[str] = []  # what is written
    start = end = items = names = 0
    times, gap, lead = 1, "", None  # lead: where a "plus" or a "double" before the run begins

    def close() -> None:
        nonlocal parts, items, names, times, gap, lead
        if items >= 3 and names >= 2:
            edits.append((start, end, "".join(parts)))
        parts, items, names, times, gap, lead = [], 0, 0, 1, "", None

    def add(m: re.Match, digits: str, named: bool) -> None:
        nonlocal start, end, items, names, times, gap, lead
        if not items:
            start = m.start() if lead is None else lead
        parts.append((gap if items else "") + digits * times)
        end, items, names = m.end(), items + 1, names + named
        times, gap, lead = 1, "", None

    for m in _SPOKEN_PART.finditer(text):
        word, digits, mark = m.groups()
        if mark:
            if "." in mark:
                gap = "."
        elif digits:
            add(m, digits, False)
        elif word and ((w := word.lower()) in _SPELLED or w in _INSIDE and items):
            add(m, _SPELLED.get(w) or _INSIDE[w], True)
        elif word and w in _POINT and items:
            gap = "."
        elif word and w in _TIMES:
            times, lead = _TIMES[w], m.start() if not items and lead is None else lead
        elif word and w in _PLUS:
            close()
            parts, lead = ["+"], m.start()
        else:
            close()
    close()
    return edits


#: at and dot in brackets, or spelled, or spaced out.  Every repetition is possessive and starts
#: at a word's beginning, so reading is linear and no length is bounded.
_AT_NAMES = "arroba|arobase|arobas|klammeraffe|ät"
_AT = rf"\s*+[\[({{<]\s*+(?:at|@|{_AT_NAMES})\s*+[\])}}>]\s*+"
_AT_LETTER = r"\s*+[\[({<]\s*+a\s*+[\])}>]\s*+"
_DOT = r"\s*+[\[({<]\s*+(?:dot|\.|punkt|punto|point)\s*+[\])}>]\s*+"
_SPELLED_DOT = r"\s++(?:dot|punkt|punto|point)\s++"
_SPACED_DOT = r"\s++\.\s++"
_LABEL = r"[A-Za-z0-9-]++"
_LOCAL_RUN = r"[A-Za-z0-9._%+-]++"
_ADDRESS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])({_LOCAL_RUN})(?:({_AT})|({_AT_LETTER})|(\s*+@\s*+|\s++(?:{_AT_NAMES})\s++)|(\s++(?:at|chez)\s++))({_LABEL}(?:(?:{_DOT}|\.|{_SPELLED_DOT}|{_SPACED_DOT}){_LABEL})++)")
_HOST_PART = re.compile(rf"(?i)({_LABEL})|({_DOT})|({_SPELLED_DOT})|({_SPACED_DOT})|(\.)")
#: Last labels that need no further sign: general ones, and after a spelled or spaced dot the countries'.
_TOP = frozenset("com org net edu gov mil int info biz io dev app example invalid test".split())
_COUNTRY = re.compile(
    "a[cdefgilmoqrstuwxz]|b[abdefghijlmnoqrstvwyz]|c[acdfghiklmnoruvwxyz]|d[ejkmoz]|e[cegrstu]|f[ijkmor]|g[abdefghilmnpqrstuwy]|h[kmnrtu]|i[delmnoqrst]|j[emop]|k[eghimnprwyz]|"
    "l[abcikrstuvy]|m[acdeghklmnopqrstuvwxyz]|n[acefgilopruz]|om|p[aefghklmnrstwy]|qa|r[eosuw]|s[abcdeghijklmnorstuvxyz]|t[cdfghjklmnortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw]"
)
#: No host begins with an article ("look at the dot in it").
_ARTICLES = frozenset("the a an this that each every".split())
#: Words among the three before an address, after which any last label counts.
_INTRODUCED = frozenset("email e-mail mail courriel correo contact contacto kontakt write address adresse reach".split())
#: Words that are no name: a plain "at" after them, or after one that a subject stands before, is a place or a page.
_SUBJECTS = frozenset("i we you he she it they who to not also just je tu il elle on nous vous ils elles ich wir er sie ihr yo ella nosotros ellos".split())
_NOT_NAMES = _SUBJECTS | frozenset(
    "us me them him her this that these those there here one ones more all everything anything something much many only and or but as so then now today tomorrow again "
    "is are was were be been being am do does did done has have had will would can could may might must shall should let "
    "look looks looked looking meet meets met meeting work works worked working live lives lived living stay stays stayed staying arrive arrives arrived stop stops stopped sit sits sat stand stands stood "
    "see sees seen saw find finds found read reads visit visits visited shop shops buy buys bought order orders ordered start starts started stare stares stared point points pointed aim aims aimed "
    "available online hosted published posted located based listed sold website site page pages blog store news office people team life home school shares prices employees engineer engineers manager "
    "est suis es sommes sont va vais vas vont vient viens venu allé restez venez allez reste dîner manger travaille travaillent habite habitent achète acheté trouvé bin ist sind war waren arbeitet wohnt trabaja vive está".split()
)
_LOCAL_DOTS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)++(?={_AT}|\s*+@)")
_BRACKET_DOT = re.compile(rf"(?i){_DOT}")
_JOINED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9.%+]++(?:[_-](?!at[_-])[A-Za-z0-9.%+]++)*+)[_-]at[_-]([A-Za-z0-9]++)((?:[_-]dot[_-][A-Za-z0-9]++)++)(?![A-Za-z0-9_-])")
_AT_HINT = re.compile(
    rf"(?i)[\[({{<]\s*+(?:at|a|@|{_AT_NAMES})\s*+[\])}}>]|\s(?:{_AT_NAMES})\s|[_-]at[_-]|"
    r"\s@|@\s|\s(?:dot|punkt|punto|point)\s|[\[({<]\s*+(?:dot|\.|punkt|punto|point)\s*+[\])}>]"
)


def has_sign(text: str) -> bool:
    """Whether an "at" or "dot" in disguise may stand in the text."""
    if not any(c in text for c in "[({<@"):
        low = text.lower()
        if not any(w in low for w in ("dot", "punkt", "punto", "point", "arroba", "arobas", "klammeraffe", " ät ")):
            return False
    return _AT_HINT.search(text) is not None


class Tape:
    """A text whose every character knows the source span it came from."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint spans, in order; each written character maps to its whole span."""
        if not edits:
            return
        old = self.start or list(range(len(self.text))), self.end or list(range(1, len(self.text) + 1))
        parts, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += (self.text[at:a], new)
            start += old[0][at:a]
            end += old[1][at:a]
            if new:
                start += [old[0][a]] * len(new)
                end += [old[1][b - 1]] * len(new)
            at = b
        self.text, self.start, self.end = "".join(parts), start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (self.start[a], self.end[b - 1]) if self.start is not None else (a, b)


def _words_before(text: str, at: int, many: int = 3) -> list[str]:
    """The last words before a place in the same line, nearest first, in lower case and without marks."""
    out: list[str] = []
    while len(out) < many:
        while at and text[at - 1] in " \t,;:()<>\"'":
            at -= 1
        end = at
        while at and not text[at - 1].isspace() and text[at - 1] not in ",;:()<>\"'":
            at -= 1
        if at == end or text[at:end] == "@":
            break
        out.append(text[at:end].lower())
    return out


def _address(m: re.Match) -> tuple[int, int, str] | None:
    """The address that a match writes, if its parts are signs enough that it is one."""
    local, bracket, letter, sign, word, host = m.groups()
    labels, seps = [], []  # how each label is divided from the one before
    for p in _HOST_PART.finditer(host):
        if p.group(1):
            labels.append(p.group(1))
        else:
            seps.append("bracket" if p.group(2) else "spelled" if p.group(3) else "spaced" if p.group(4) else "plain")
    if sign == "@" and not {"bracket", "spelled", "spaced"} & {*seps}:
        return None  # plain
    if bracket or "bracket" in seps:
        return m.start(), m.end(), local + "@" + ".".join(labels)
    if labels[0].lower() in _ARTICLES:
        return None
    before = _words_before(m.string, m.start())
    marked = bool(sign) or re.search(r"[0-9._%+-]", local) or word and word.strip() == "AT" or not _INTRODUCED.isdisjoint(before)
    if word and not re.search(r"[0-9._%+-]", local):
        # A verb, a pronoun or a thing before "at": people meet at places, and pages are found at hosts.
        if local.lower() in _NOT_NAMES or (before and before[0] in _SUBJECTS and _INTRODUCED.isdisjoint(before)):
            return None
    # The longest part of the host whose last label is a known ending, then any ending if the address looks like one.
    stops = [p.end() for p in _HOST_PART.finditer(host) if p.group(1)]
    for k in range(len(labels) - 1, 0, -1):
        last, how = labels[k].lower(), seps[k - 1]
        known = last in _TOP or how != "plain" and _COUNTRY.fullmatch(last) or (letter or sign and sign.strip() != "@") and _COUNTRY.fullmatch(last)
        loose = how == "spelled" and marked and len(last) >= 2 and last.isalpha() and last not in _ARTICLES
        if known or loose:
            return m.start(), m.start(6) + stops[k], local + "@" + ".".join(labels[: k + 1])
    return None


def _joined(m: re.Match) -> tuple[int, int, str] | None:
    """An address whose words are joined by underscores or hyphens (bob_at_host_dot_org)."""
    labels = [m.group(2), *re.split(r"(?i)[_-]dot[_-]", m.group(3))[1:]]
    last = labels[-1].lower()
    return (m.start(), m.end(), m.group(1) + "@" + ".".join(labels)) if last in _TOP or _COUNTRY.fullmatch(last) else None


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers, in source positions, that no base span covers whole."""
    disguised = [] if text.isascii() else [c for c in {*text} if look(c) != c]
    named, at = has_name(text), has_sign(text)
    if not (disguised or named or at):
        return []
    tape = Tape(text)
    if disguised:
        tape.rewrite([(m.start(), m.end(), look(m.group())) for m in re.finditer("[" + re.escape("".join(disguised)) + "]", text)])
        named, at = has_name(tape.text), has_sign(tape.text)
    if named:
        tape.rewrite(spoken(tape.text))
    if at:
        tape.rewrite([(m.start(), m.end(), _BRACKET_DOT.sub(".", m.group())) for m in _LOCAL_DOTS.finditer(tape.text)])
        tape.rewrite([e for e in map(_joined, _JOINED.finditer(tape.text)) if e])
        tape.rewrite([e for e in map(_address, _ADDRESS.finditer(tape.text)) if e])
    if tape.start is None:
        return []
    # Only what a rewriting touched can be new.
    taken = sorted((a, b) for a, b, _ in base)
    out = []
    for a, b, kind in base_spans(tape.text):
        lo, hi = tape.source(a, b)
        if text[lo:hi] != tape.text[a:b] and not any(x <= lo and hi <= y for x, y in taken):
            out.append((lo, hi, kind))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base), key=order)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    spans = find(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += (text[at:a], f"[{kind.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and ``base_sha256`` are of the base patterns alone, ``spans`` has all.  A null or
    empty text has none; a null id stays null; repeated rows are read each on its own; texts and
    identifiers may have any length; spans that start together (ties) stand in the order of
    ``KINDS``.  Other columns are ignored; an empty table gives no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                base, spans = find(text)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(scan, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind; other columns unchanged."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t) if isinstance(t, str) else None)

    return docs.withColumn(text_col, clean(F.col(text_col)))
