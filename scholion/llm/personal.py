"""Problem 4: personal information in free text, found by anchor expansion and replaced by placeholders.

An Aho-Corasick automaton finds anchors in one pass over the lower-cased text: at-signs and their
spelled forms, identifier cues, street words, forms of address, role cues and given names. From
each anchor a deterministic local parser expands to the boundaries of the item and validates it;
telephone numbers have no cue of their own and are anchored at runs of digits. The text is first
brought to the form of problem 6, so disguised characters change nothing.

Given names are learned from bibliographic records (all of them): those that make GIVEN_SHARE of all
given names there, so that the list is the same at every size and has 1 / GIVEN_SHARE entries at
most; names beside a form of address or a role cue are found without it.

Defined results: null texts have no items and stay null, empty texts stay empty; overlapping items
are merged in favour of the longer; repeated rows give equal results; long texts are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.lookalikes import Classes
from scholion.runtime import cut

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
#: Least share of a given name of the list in all given names; words that an address or a name may reach over on each side of its anchor.
GIVEN_SHARE, ADDRESS_WORDS, NAME_WORDS = 2e-5, 10, 4

# Cue words of the anchors.
AT_SIGNS = ("@", "(at)", "[at]", "{at}")
ID_CUES = (
    "passport", "id card", "identity card", "dni", "nie", "ssn", "social security", "ni number", "national insurance", "driving licence", "driver's license",
    "driving license", "student id", "student number", "matriculation", "matrikel", "patient", "personalausweis", "reisepass", "carte d'identité", "tax id", "tax number", "steuer-id", "nif",
)
STREET_WORDS = ("street", "road", "rd", "avenue", "ave", "lane", "row", "terrace", "drive", "close", "crescent", "square", "boulevard", "court", "place", "way", "st")
STREET_CUES = ("straße", "strasse", "weg", "gasse", "platz", "allee", "calle", "avenida", "plaza", "rue", "avenue", "via", "p.o.", "po box", "postfach", "apartado", "street", "road", "rd.", "ave.", "lane", " row", "terrace", "drive", "close", "crescent", "square", "boulevard", " court", " place", " way", " st.")
TITLES = ("mr", "mrs", "ms", "miss", "mme", "mlle", "dr", "prof", "herr", "frau", "sr", "sra", "señor", "señora", "don", "doña", "monsieur", "madame")
ROLES = ("neighbour ", "neighbor ", "tenant ", "witness: ", "essay by ", "submitted by ", "interview, ", "i thank ", "sheet of ", "abuela, ", "abuelo, ", "write to ", "signed by ", "contact person ")
NOT_NAMES = frozenset("Church Priory Abbey Street Road Lane Avenue Hall School College University Library Archive Press Review Journal House Bridge Castle Museum Institute Society Hospital Square Park Row Terrace County".split())
NOT_PHONES = frozenset("item form issn isbn doi grant no nr box room folder version vol volume page pp p pages seite № catalogue table figure file art article dni ssn nie card licence license passport number record id matrikel-nr lot ref reference".split())

_U = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_L = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľŀłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_CAP = f"[{_U}](?:[{_L}'’]+)(?:[{_U}][{_L}]+)?"
_SURNAME = rf"{_CAP}(?:\s?-\s?{_CAP})?"
_INITIAL = rf"[{_U}]\."
_EMAIL = re.compile(
    r"<?[A-Za-z0-9][A-Za-z0-9._%+-]*\s?(?:@|\(at\)|\s?\[at\]\s?|\{at\})\s?[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)*(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z]{2,}>?", re.I
)
_ID = re.compile(r"[^\w\n]{0,3}(?:(?:number|no|nr|n°|nº|card|record|id|#)\.?[\s:.]{0,3}){0,3}[\s:#]{0,3}([A-Za-z]{0,3}[\s-]?\d[\dA-Za-z/ .-]{3,16}[\dA-Za-z])", re.I)
_BOX = re.compile(r"(?:P\.\s?O\.\s?Box|PO\s?Box|Postfach|Apartado(?:\s+de\s+correos)?)\s+\d+(?:,\s*[^\W\d_][^,.;()]{1,40}?\s\d{4,6})?", re.I)
_NUM = r"\d{1,4}[A-Za-z]?"
_TOWN = rf"(?:,\s*(?:\d{{4,6}}\s+)?{_CAP}(?:\s+\d{{4,6}})?)?"
_STREETS = (
    re.compile(rf"(?:(?:Flat|Apt\.?|Apartment|Unit)\s+\d+[A-Za-z]?,\s*)?(?:No\.\s*)?{_NUM},?\s+(?:The\s+|Old\s+|New\s+|Upper\s+|Lower\s+)?(?:{_CAP}\s+){{1,3}}(?:Street|Road|Rd\.|Avenue|Ave\.|Lane|Row|Terrace|Drive|Close|Crescent|Square|Boulevard|Court|Place|Way|St\.)(?!\w)(?:,\s*(?:Apt\.?|Flat)\s+\d+)?{_TOWN}"),
    re.compile(rf"{_NUM},?\s+(?:rue|avenue|boulevard|place)\s+(?:de\s+la\s+|de\s+|du\s+|des\s+|d['’])?{_CAP}{_TOWN}"),
    re.compile(rf"(?:Calle|Avenida|Plaza|Via)\s+(?:de\s+)?{_CAP}\s+{_NUM}{_TOWN}"),
    re.compile(rf"[{_U}][{_L}]+(?:straße|strasse|weg|gasse|platz|allee)\s+{_NUM}{_TOWN}"),
)
_RUN = re.compile(r"(?<![\w.@/])(?:\+|\(?\d)[\d\s().-]{5,22}\d(?:\s*(?:ext|x|Durchwahl)\.?\s*\d{1,5})?(?![\w@])")
_PHONES = tuple(
    re.compile(p + r"(?:\s*(?:ext|x|Durchwahl)\.?\s*\d{1,5})?")
    for p in (
        r"(?:\+|00\s?)[1-9]\d{0,2}[\s.-]?(?:\(0\)\s?)?\d(?:[\s.-]{0,2}\d){6,11}",
        r"(?:1[\s.-])?\(\d{3}\)\s?\d{3}[\s.-]{1,2}\d{4}",
        r"1[\s.-]\d{3}[\s.-]{1,2}\d{3}[\s.-]{1,2}\d{4}",
        r"\d{3}([\s.-])\s?\d{3}\1\s?\d{4}",
        r"0\d{2,5}\)?[\s/-]{1,2}\d{2,8}(?:[\s-]{1,2}\d{2,5}){0,3}",
        r"\d{3}-\s?\d{4}|\d{3} \d{4}(?=\s*(?:ext|x|Durchwahl)\.?\s*\d)",
    )
)


# Wide signs as ordinary ones; every position stays.
_WIDE = re.compile("[\uff01-\uff5e]")
_ORDINARY = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


class Item(NamedTuple):
    start: int
    end: int
    kind: str


class Finder:
    """The anchors and parsers for one list of given names."""

    def __init__(self, given: frozenset[str]):
        import ahocorasick

        self.given, self.anchors = given, ahocorasick.Automaton()
        cues: dict[str, str] = {}
        for kind, words in (("person_name", [g.lower() for g in given]), ("street_address", STREET_CUES), ("id_number", ID_CUES), ("role", ROLES), ("title", [t for t in TITLES]), ("email", AT_SIGNS)):
            for w in words:
                cues[w] = cues.get(w, "") + " " + kind
        for w, kinds in cues.items():
            self.anchors.add_word(w, (len(w), tuple(kinds.split())))
        self.anchors.make_automaton()
        self.title = re.compile(rf"(?i:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s+(?:(?:{_CAP}|{_INITIAL})\s+){{0,2}}{_SURNAME}")
        self.full = re.compile(rf"({_CAP})\s+(?:{_INITIAL}\s*)?({_SURNAME})")
        self.back = re.compile(rf"({_SURNAME}),\s+({_CAP})(?:\s+{_INITIAL})?$")
        self.role = re.compile(rf"(?:(?:{_CAP}|{_INITIAL})\s+){{1,2}}{_SURNAME}|{_SURNAME},\s+{_CAP}(?:\s+{_INITIAL})?(?!\w)")

    def items(self, text: str) -> list[Item]:
        """The items of a text in the form of problem 6, in order and without overlap."""
        text = text.replace("\n", " ").replace("\r", " ").replace("\t", " ")
        if _WIDE.search(text):
            text = text.translate(_ORDINARY)
        flat = text.lower()
        if len(flat) != len(text):
            flat = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found: list[Item] = []
        for last, (size, kinds) in self.anchors.iter(flat):
            start, end = last + 1 - size, last + 1
            for kind in kinds:
                found += self._expand(text, kind, start, end)
        if any("0" <= c <= "9" for c in text):
            for m in _RUN.finditer(text):
                found += self._phone(text, m)
        return _merged(found)

    def _expand(self, text: str, kind: str, start: int, end: int) -> list[Item]:
        if kind == "email":
            m = _EMAIL.match(text, _local_part(text, start))
            return [Item(m.start(), m.end(), kind)] if m and m.end() > start else []
        if kind == "id_number":
            if start and text[start - 1].isalnum():
                return []
            m = _ID.match(text, _word_end(text, end))
            if not m or sum(c.isdigit() for c in m[1]) < 5:
                return []
            stop = m.start(1) + _number_end(m[1])
            return [Item(start, stop, kind)] if sum(c.isdigit() for c in text[m.start(1) : stop]) >= 5 else []
        if kind == "street_address":
            lo, hi = _words_back(text, start, ADDRESS_WORDS), _words_on(text, end, ADDRESS_WORDS)
            return [
                Item(lo + m.start(), lo + m.end(), kind)
                for p in (_BOX, *_STREETS) for m in p.finditer(text[lo:hi])
                if lo + m.start() <= start and end <= lo + m.end() + 1 and not (lo + m.start() and text[lo + m.start() - 1].isalnum())
            ]
        if kind == "title":
            if start and text[start - 1].isalnum() or not text[start].isupper():
                return []
            m = self.title.match(text, start)
            return [Item(start, m.end(), "person_name")] if m and not _institution(m[0]) and not _cited(text, m.end()) else []
        if kind == "role":
            m = self.role.match(text, end)
            return [Item(end, m.end(), "person_name")] if m and not _institution(m[0]) and not _cited(text, m.end()) else []
        if start and (text[start - 1].isalnum() or text[start - 1] in "@._+-/") or text[end : end + 1].isalnum() or text[start:end] not in self.given:
            return []
        before = text[max(0, start - 4) : start]
        if re.search(r"(?:St|San|Ste)\.?\s$", before):
            return []
        if (m := self.full.match(text, start)) and not _institution(m[2]) and not _cited(text, m.end()):
            return [Item(start, m.end(), kind)]
        lo = _words_back(text, start, NAME_WORDS)
        if (m := self.back.search(text[lo:end])) and not _cited(text, end):
            return [Item(lo + m.start(), end, kind)]
        return []

    @staticmethod
    def _phone(text: str, run: re.Match) -> list[Item]:
        raw = run[0]
        if sum(c.isdigit() for c in raw) < 7:
            return []
        before = re.search(r"([^\W\d_]+(?:-Nr)?|№)[\s.:#]*$", text[max(0, run.start() - 24) : run.start()])
        if before and before[1].lower() in NOT_PHONES and not re.search(r"(?i)(?:tel|phone|fax|mobile)\W*(?:no|nr|number)[\s.:]*$", text[max(0, run.start() - 24) : run.start()]):
            return []
        # The number may stand in brackets or follow another number: every group of digits is tried as its start.
        for at in (k for k in range(len(raw)) if (raw[k].isdigit() or raw[k] in "+(") and (not k or raw[k - 1] in " (" or raw[k] == "+")):
            for p in _PHONES:
                if m := p.match(raw, at):
                    tail = raw[m.end() :]
                    digits = sum(c.isdigit() for c in m[0])
                    if not 7 <= digits <= 15 or tail and (tail[0].isdigit() or re.match(r"[-.]\d", tail)):
                        continue
                    if re.fullmatch(r"\d{4}[-.]\d{2}[-.]\d{2}", m[0]):
                        continue
                    return [Item(run.start() + at, run.start() + m.end(), "phone")]
        return []

    def redact(self, text: str) -> str:
        """`text` with every item replaced by its typed placeholder."""
        out, last = [], 0
        for start, end, kind in self.items(text):
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
        return "".join([*out, text[last:]])


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _local_part(text: str, at: int) -> int:
    """Where the local part before an at-sign starts, with an opening bracket; a blank may stand between."""
    if at and text[at - 1] == " ":
        at -= 1
    end = at
    while at and text[at - 1] in _LOCAL:
        at -= 1
    while at < end and text[at] in "._%+-":
        at += 1
    return at - 1 if at and text[at - 1] == "<" else at


def _words_back(text: str, at: int, n: int) -> int:
    """Where the n-th word before a place starts."""
    for _ in range(n):
        while at and text[at - 1] == " ":
            at -= 1
        while at and text[at - 1] != " ":
            at -= 1
    return at


def _words_on(text: str, at: int, n: int) -> int:
    """Where the n-th word after a place ends."""
    for _ in range(n):
        while at < len(text) and text[at] == " ":
            at += 1
        while at < len(text) and text[at] != " ":
            at += 1
    return at


def _word_end(text: str, at: int) -> int:
    while at < len(text) and text[at].isalpha():
        at += 1
    return at


def _number_end(raw: str) -> int:
    """Where the number ends in what follows a cue: words after it do not belong to it."""
    m = re.match(r"(?:[A-Za-z]{1,3}[\s-]?)?\d[\d/.-]*[A-Za-z]?(?![A-Za-z])(?:[\s-]\d[\d/.-]*)*(?:[\s-][A-Z](?![A-Za-z]))?", raw)
    return len(m[0].rstrip(" .-/")) if m else len(raw)


def _institution(name: str) -> bool:
    return any(w in NOT_NAMES for w in re.findall(r"\w+", name))


def _cited(text: str, end: int) -> bool:
    """Whether what follows a name makes it a citation."""
    return bool(re.match(r"\s*(?:\(\d{4}|,\s*\d{4}[a-z]?\s*[,)]|et\s+al|,?\s+as\s+cited)", text[end : end + 24]))


def _merged(found: list[Item]) -> list[Item]:
    kept: list[Item] = []
    for item in sorted(set(found), key=lambda i: (i.start - i.end, i.start, i.kind)):
        if all(item.end <= k.start or k.end <= item.start for k in kept):
            kept.append(item)
    return sorted(kept)


def given_names(people: DataFrame, column: str = "name") -> frozenset[str]:
    """The given names of bibliographic records, from `Given Surname` and `Surname, Given` forms in all rows."""
    one = people.select(F.explode(F.split(column, r"\s*(?:;|&|\band\b)\s*")).alias("n")).where("n <> ''")
    first = one.select(F.coalesce(F.nullif(F.regexp_extract("n", r"^[^,]+,\s*([\p{Lu}][\p{Ll}]{2,})(?:\s+\p{Lu}\.)*$", 1), F.lit("")), F.regexp_extract("n", r"^([\p{Lu}][\p{Ll}]{2,})\s+(?:\p{Lu}\.\s*)?[\p{Lu}][^,]*$", 1)).alias("g"))
    counted = cut(first.where("g <> ''").groupBy("g").count())
    total = counted.agg(F.sum("count")).first()[0] or 0
    return frozenset(r["g"] for r in counted.where(F.col("count") >= total * GIVEN_SHARE).collect())


def find(df: DataFrame, id_col: str, text_col: str, given: frozenset[str], counts: dict[int, int]) -> DataFrame:
    """(id_col, kind): the kinds of personal information of every row, each kind once a row."""
    kind_of_id = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, classes = Finder(given), Classes(counts)
        for batch in batches:
            ids, kinds = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    for k in {x.kind for x in finder.items(classes.rewrite(t))}:
                        ids.append(i)
                        kinds.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string())], names=[id_col, "kind"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_of_id}, kind string")


def redact(df: DataFrame, id_col: str, text_col: str, given: frozenset[str], counts: dict[int, int]) -> DataFrame:
    """(id_col, text_col): every text with typed placeholders, in the form of problem 6."""
    kind_of_id = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, classes = Finder(given), Classes(counts)
        for batch in batches:
            new = [t and finder.redact(classes.rewrite(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=[id_col, text_col])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_of_id}, `{text_col}` string")
