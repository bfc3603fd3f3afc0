"""Problem 6: one consistent form for text that looks alike but differs in its characters.

The code points of the corpus are counted (at most one row per code point). Every code point that
may stand for another text, every string that a rule ties to it (a ligature's letters, a letter
with its accents apart), becomes a node; a union-find over these strings gives transitive look-alike
classes (fullwidth A, Greek Alpha, Cyrillic A and A are one). In each class the most frequent
ordinary member of a script represents it for that script. Rewriting is greedy: an Aho-Corasick
automaton over all variants, strings and code points, replaces the longest match at each place by
the representative, so invisible characters vanish and accents are composed; then letters of another
script are replaced in words that are otherwise Latin (or Cyrillic), by their class's representative.

In the form already, and left alone: typographic quotes, dashes, ellipses, super- and subscripts,
fractions, the numero sign, single Greek letters and Greek letters without a Latin look-alike, a
single foreign letter in quotes, punctuation of Chinese text, joiners and selectors after emoji.

Defined results: null stays null and empty stays empty (both in the form); line ends stay; the
rewriting is idempotent; repeated rows give equal results; long texts are rewritten as a whole;
a column named like an output column is replaced only where the caller asks for it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC_LIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ԝ": "W", "Х": "X", "У": "Y",
}
GREEK_LIKE = {
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}

_FIRST_MARK, _LAST_MARK = 0x300, 0x36F
_LATIN, _CYRILLIC, _GREEK = "LATIN", "CYRILLIC", "GREEK"
_QUOTES = "\"'“”‘’„‚«»‹›"
_WORD = re.compile(r"[^\W\d_][̀-ͯ]*(?:[^\W\d_][̀-ͯ]*)*")


@lru_cache(maxsize=None)
def script(char: str) -> str:
    """The first word of the character's name where it is a letter of an alphabet with look-alikes, else ''."""
    name = unicodedata.name(char, "").partition(" ")[0]
    return name if name in (_LATIN, _CYRILLIC, _GREEK) else ""


def ordinary(code: int) -> str | None:
    """The text in ordinary characters that a code point stands for whatever its surroundings, or None.

    A blank for other blanks, '' for what is invisible, letters and digits for wide, narrow, styled
    or joined ones and for digits of another script.
    """
    c = chr(code)
    kind = unicodedata.category(c)
    if c in "\n\r " or 0xD800 <= code < 0xE000:
        return None
    if kind == "Zs" or c == "\t":
        return " "
    if kind in ("Cf", "Cc") or 0xFE00 <= code < 0xFE10 or c in "͏ᅟᅠㅤﾠ":
        return ""
    if kind == "Nd" and code > 127:
        return str(unicodedata.digit(c))
    if kind[0] == "L" and (d := unicodedata.decomposition(c)).startswith("<"):
        how = d.partition(">")[0][1:]
        flat = unicodedata.normalize("NFKC", c)
        if how in ("wide", "narrow", "font") or how == "compat" and len(flat) > 1 and flat.isalpha():
            return flat
    return None


class Classes:
    """Look-alike classes of the given code points, and the rewriting they imply."""

    def __init__(self, counts: dict[int, int]):
        self._up: dict[str, str] = {}
        borrowed = CYRILLIC_LIKE | GREEK_LIKE  # accents of letters that may be another script's are composed last
        variants = {chr(code): p for code in counts if (p := ordinary(code)) is not None}
        marks = [chr(code) for code in counts if _FIRST_MARK <= code <= _LAST_MARK]
        if marks:
            variants |= {c + m: one for code in counts if (c := chr(code)).isalpha() and c not in borrowed for m in marks if len(one := unicodedata.normalize("NFC", c + m)) == 1}
        for v, p in variants.items():
            self._join(v, p)
        for other, latin in borrowed.items():
            self._join(other, latin)
        members: dict[str, list[str]] = {}
        for node in list(self._up):
            members.setdefault(self._find(node), []).append(node)
        rank = lambda c: (counts.get(ord(c), 0) if len(c) == 1 else 0, -len(c), c)
        #: {(class, script): representative}; the representative is an ordinary character or string
        self.best: dict[tuple[str, str], str] = {}
        for root, nodes in members.items():
            plain = [n for n in nodes if n in ("", " ") or all(ordinary(ord(x)) is None for x in n)]
            for s in (_LATIN, _CYRILLIC, _GREEK, ""):
                own = [n for n in plain if (script(n[0]) if n else "") == s]
                if own:
                    self.best[root, s] = max(own, key=rank)
        #: Variants that are replaced wherever they stand, and what represents their class in the script of their ordinary form.
        self.always = {v: self.best.get((self._find(v), script(p[0]) if p else ""), p) for v, p in variants.items()}
        #: Letters that have a look-alike in another script, by script: {letter: {script: letter}}.
        self.across: dict[str, dict[str, str]] = {}
        for other, latin in borrowed.items():
            root = self._find(other)
            for letter in (other, latin):
                self.across.setdefault(letter, {}).update({s: self.best[root, s] for s in (_LATIN, _CYRILLIC, _GREEK) if (root, s) in self.best})
        self._automaton = ahocorasick.Automaton()
        for v, p in self.always.items():
            self._automaton.add_word(v, (len(v), p))
        if self.always:
            self._automaton.make_automaton()
        self._variant = re.compile("[" + "".join(map(re.escape, sorted({v[-1] for v in self.always}))) + "]") if self.always else None
        self._foreign = re.compile("[" + "".join(borrowed) + "]")

    def _find(self, x: str) -> str:
        self._up.setdefault(x, x)
        while self._up[x] != x:
            self._up[x] = self._up[self._up[x]]
            x = self._up[x]
        return x

    def _join(self, a: str, b: str) -> None:
        a, b = sorted((self._find(a), self._find(b)), key=lambda n: (len(n), n))
        self._up[b] = a

    def _plain(self, text: str) -> str:
        """Every variant replaced that does not depend on its word, the longest first; selectors and joiners of emoji stay."""
        if self._variant is None or not self._variant.search(text):
            return text
        out, last = [], 0
        for end, (size, new) in self._automaton.iter_long(text):
            start = end + 1 - size
            if new or not self._joins(text, start):
                out += [text[last:start], new]
                last = end + 1
        return "".join([*out, text[last:]])

    @staticmethod
    def _joins(text: str, at: int) -> bool:
        """Whether a joiner or selector belongs to an emoji before it."""
        if text[at] != "\u200d" and not "\ufe00" <= text[at] <= "\ufe0f":
            return False
        before = at - 1
        while before >= 0 and "\ufe00" <= text[before] <= "\ufe0f":
            before -= 1
        return before >= 0 and unicodedata.category(text[before]) in ("So", "Sk")

    def _words(self, text: str) -> str:
        """Letters borrowed from another script replaced, word by word; `text` is decomposed."""
        found = list(_WORD.finditer(text))
        letters = [[c for c in m[0] if not "̀" <= c <= "ͯ"] for m in found]
        kinds = []
        for cs in letters:
            sure = [script(c) for c in cs if c not in self.across]
            seen = {script(c) for c in cs} - {""}
            main = next((s for s in (_LATIN, _CYRILLIC) if s in sure), _GREEK if _GREEK in sure else "")
            if _LATIN in sure and _CYRILLIC in sure:
                main = max((_LATIN, _CYRILLIC), key=sure.count)
            kinds.append((main, seen))
        out, last = [], 0
        for k, (m, cs, (main, seen)) in enumerate(zip(found, letters, kinds)):
            target = main
            if not main and seen:  # only letters that look alike
                # One Greek letter is a symbol; one letter in quotes is named as such; p. and pp. are page marks.
                if len(cs) == 1 and (seen == {_GREEK} and len(m[0]) == 1 and not (text[m.start() - 1 : m.start()] == "." or text[m.end() : m.end() + 1] == ".") or text[max(m.start() - 1, 0)] in _QUOTES and text[m.end() : m.end() + 1] in _QUOTES and m.end() < len(text)):
                    continue
                if m[0].lower() in ("p", "pp") and text[m.end() : m.end() + 1] == ".":
                    continue
                if seen == {_LATIN} and not self._amid_cyrillic(text, found, kinds, k, cs):
                    continue
                before = next((kinds[j][0] for j in range(k - 1, -1, -1) if kinds[j][0]), "")
                after = next((kinds[j][0] for j in range(k + 1, len(kinds)) if kinds[j][0]), "")
                around = {before, after} - {""}
                target = around.pop() if len(around) == 1 else max(seen, key=lambda s: sum(script(c) == s for c in cs)) if len(seen) > 1 else ""
                if target == _GREEK:
                    target = _LATIN
            if not target or seen <= {target} or target == _GREEK:
                continue
            out += [text[last : m.start()], "".join(self.across[c].get(target, c) if c in self.across and script(c) != target else c for c in m[0])]
            last = m.end()
        return "".join([*out, text[last:]]) if out else text

    @staticmethod
    def _amid_cyrillic(text: str, found: list, kinds: list, k: int, letters: list[str]) -> bool:
        """Whether a word of Latin letters stands between Cyrillic words with only blanks and digits beside it."""
        if not all(c in "aceopxyABCEHKMOPTXY" for c in letters):
            return False
        beside = []
        if k:
            beside.append((kinds[k - 1][0], text[found[k - 1].end() : found[k].start()]))
        if k + 1 < len(found):
            beside.append((kinds[k + 1][0], text[found[k].end() : found[k + 1].start()]))
        return bool(beside) and all(s == _CYRILLIC and re.fullmatch(r"[\s\d]+", gap) for s, gap in beside)

    def rewrite(self, text: str | None) -> str | None:
        """`text` in the consistent form."""
        if text is None or text.isascii() and not (self._variant and self._variant.search(text)):
            return text
        now = self._plain(text)
        if self._foreign.search(now):
            now = self._words(unicodedata.normalize("NFD", now))
        return now if unicodedata.is_normalized("NFC", now) else unicodedata.normalize("NFC", now)


def code_points(tables: list[tuple[DataFrame, str]]) -> dict[int, int]:
    """{code point: occurrences} over whole columns; the result has at most one entry per code point there is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            text = "".join(t for t in batch.column(0).to_pylist() if t)
            if text:
                n = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    parts = [df.select(F.col(c).alias("text")).mapInArrow(count, "code bigint, n bigint") for df, c in tables]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return {r["code"]: r["n"] for r in both.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def rewrite(df: DataFrame, column: str, counts: dict[int, int], keep: list[str], out: str = "form", changed_only: bool = False) -> DataFrame:
    """(*keep, out): `column` in the consistent form; with `changed_only`, only rows that are not in it."""
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(counts)
        for batch in batches:
            old = batch.column(len(keep)).to_pylist()
            new = [classes.rewrite(t) for t in old]
            result = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(new, pa.string())], names=[*keep, out])
            yield result.filter(pa.array([a != b for a, b in zip(old, new)], pa.bool_())) if changed_only else result

    return df.select(*keep, column).mapInArrow(run, schema)
