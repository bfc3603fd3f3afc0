"""Problem 2: repair of text read from scanned pages.

Words are counted over a clean corpus (all of it); a word is frequent from a fixed share of all
words on, so the lexicon has at most 1 / RARE entries and may be broadcast. Skip-gram vectors with
negative samples are learned from the co-occurrence counts of all texts: pairs are aggregated
first, workers take gradient steps on their share of the pairs, and the vectors are averaged each
round; only the bounded vectors reach the driver. A rare word is linked to the frequent words that
usual glyph edits lead to (rn for m, 0 for o, ...), and of several the one whose vector suits the
words around best is taken. Where there is none, one letter may have been taken for any other: the
words that differ in one letter are candidates if their vectors suit the words around far better
than words do on average (SURE deviations). Then the furniture of the page goes (running headers,
page numbers, stray marks), broken and spaced words are joined, run-together words are parted, and
lines are reflowed into paragraphs.

Left alone: line ends between whole words, verse, numbered items, suspended hyphens, formulas,
codes, page references, and spellings in quotes. A text is a case if anything but its line ends was
repaired.

Defined results: null stays null, empty stays empty (no cases); repeated rows give equal results;
long texts are taken whole; an empty clean corpus leaves only the rules that need no lexicon.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.lookalikes import Classes
from scholion.runtime import cut

#: Least share of all words, and least count, of a frequent word.
RARE, LEAST = 1e-6, 3
#: Least share of a word of the scanned texts that the clean ones lack; how much more frequent the word it was misread from is.
OFTEN, MANY = 1e-5, 25
#: Words that get vectors occur at least in this share; length of vectors, words beside, negatives, rounds.
SHARE, DIM, WINDOW, NEGATIVES, ROUNDS = 1e-5, 16, 2, 3, 2

#: By how many deviations more than all words a word has to suit its surroundings where no usual glyph edit leads to it; its least letters.
SURE, LETTERS = 2.0, 6
#: Share of all words from which a word counts as common.
COMMON = 1e-4

# What the reader makes of a glyph, seen -> meant.
GLYPHS = (
    ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("ii", "n"), ("u", "ii"), ("li", "h"), ("h", "li"),
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("|", "l"), ("u", "n"), ("n", "u"), ("3", "e"),
)
CONNECTORS = frozenset("and or to und oder bis et ou à y e o u и или".split())

_TOKEN = re.compile(r"[^\W_]+")
_MAIL = re.compile(r"<?\S*(?:@|\(at\)|\{at\})\S*|\S+\s\[at\]\s\S+(?:\s\[dot\]\s\S+)*|https?://\S+|\\\\\S+")
_BREAK = re.compile(r"([^\W\d_]+)[-¬‐]([ \t]*\r?\n\s*|[ \t]+)([^\W\d_]+)")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_MARKS = re.compile(r"[~^¦`¬|•·\\¨´]")
_LEGIT = re.compile(r"~\s?\d|\w\|\w|\d\^\d|\w+ \| \w+ \| \w+|:\s*•[^•]+(?:•[^•]+)+|(?:^|\n)\s*•\s.+(?:\n\s*•\s.+)+|\\\\\S+")
_NUMBER = re.compile(r"(?<![\w.])(?=[\dlIOo]*\d)(?=[\dlIOo]*[lIOo])(?:[\dlIOo]{3,}|l\d|\d[lO])(?=(?:th|st|nd|rd)?(?!\w))")
_ROMAN = re.compile(r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_BARE = re.compile(r"\d{1,4}\.?")
_FOLIO = re.compile(r"[\[·—–-]\s*\d{1,4}\s*[\]·—–-]|(?:page|seite|p\.|pag\.|página|стр\.)\s*\d{1,4}(?:\s*(?:of|/|von|de|sur|из)\s*\d{1,4})?|\d{1,4}\s+(?:of|von|sur|из)\s+\d{1,4}", re.I)
_HEAD = re.compile(
    r"\d{1,4}\s*\|\s*\D.{3,}|\d{1,4}\s{2,}\D.{3,}|\D.{3,}\s{2,}\d{1,4}|\D.{3,}\s*\|\s*\d{1,4}|(?:chapter|kapitel|chapitre|capítulo|глава)\s+\d+\s+\S.*\s\d{1,4}|[^/]{2,40}\s/\s.{3,}\s/\s\d{1,4}|[^.,;()]{6,100}\s·\s\d{1,4}|\d{1,4}\s·\s[^.,;()]{6,100}", re.I
)


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): how often each word, in lower case, occurs in a whole column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(w for w in _TOKEN.findall(t.lower()) if w.isalpha())
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return texts.select(column).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(texts: DataFrame, column: str, share: float = RARE) -> dict[str, int]:
    """{word: count} of the words that make at least `share` of a column; at most 1 / share of them."""
    counts = cut(word_counts(texts, column))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in counts.where(F.col("n") >= max(LEAST, total * share)).collect()}


def lexicon(clean: DataFrame, clean_col: str, scanned: DataFrame, scanned_col: str) -> dict[str, int]:
    """{word: count} of the frequent words of a clean column, and of words that only the other column has often.

    Of the latter, pieces of words broken at a hyphen are not counted, and a word that glyph edits
    link to a clean word MANY times as frequent there counts as misread and is left out.
    """
    words = frequent(clean, clean_col)
    whole = scanned.select(F.regexp_replace(scanned_col, r"[\p{L}]+[-¬‐]\s+[\p{L}]+", " ").alias("t"))
    here = frequent(whole, "t", OFTEN)
    links = Repairer(words)
    extra = {w: n for w, n in here.items() if w not in words and n >= LEAST * 3 and not any(here.get(o, words[o]) >= MANY * n for o in links.linked(w))}
    return words | extra


def skip_grams(texts: DataFrame, column: str, words: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, vectors, context vectors) learned over all texts by skip-grams with negative samples."""
    total = sum(words.values())
    own = sorted((w for w, n in words.items() if n >= total * SHARE), key=lambda w: (-words[w], w))
    size = len(own)
    if not size:
        return [], np.zeros((0, DIM)), np.zeros((0, DIM))
    ids = {w: i for i, w in enumerate(own)}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [ids.get(w, -1) for t in batch.column(0).to_pylist() if t for w in [*_TOKEN.findall(t.lower()), ""]]
            x, found = np.array(runs, np.int64), []
            for d in range(1, WINDOW + 1):
                a, b = x[:-d], x[d:]
                ok = (a >= 0) & (b >= 0)
                if d == 2:
                    ok &= x[1:-1] >= -1
                found += [a[ok] * size + b[ok], b[ok] * size + a[ok]]
            code, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    counted = cut(texts.select(column).mapInArrow(pairs, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))
    rng = np.random.default_rng(0)
    v, c = ((rng.random((size, DIM), np.float32) - 0.5) / DIM for _ in range(2))
    share = np.array([words[w] for w in own], float) ** 0.75
    edges = np.cumsum(share / share.sum())
    names = [f"x{i}" for i in range(DIM)]
    for turn in range(ROUNDS):
        old = texts.sparkSession.sparkContext.broadcast((v, c))

        def steps(batches: Iterator[pa.RecordBatch], old=old, turn=turn) -> Iterator[pa.RecordBatch]:
            v, c = (m.copy() for m in old.value)
            rng, seen = np.random.default_rng(turn), np.zeros((2, size), bool)
            for batch in batches:
                code, n = (np.asarray(batch.column(k)) for k in (0, 1))
                order = rng.permutation(len(code))
                for part in np.array_split(order, max(1, len(order) // 4096)):
                    a, b = code[part] // size, code[part] % size
                    w = np.log1p(n[part]).astype(np.float32)
                    for k in range(1 + NEGATIVES):
                        o = b if k == 0 else np.minimum(np.searchsorted(edges, rng.random(len(part))), size - 1)
                        g = (0.05 * w * ((k == 0) - 1 / (1 + np.exp(-np.clip((v[a] * c[o]).sum(1), -8, 8)))))[:, None].astype(np.float32)
                        dv, dc = g * c[o], g * v[a]
                        _add(v, a, dv)
                        _add(c, o, dc)
                        seen[0, a] = seen[1, o] = True
            for k, m in enumerate((v, c)):
                at = np.flatnonzero(seen[k])
                yield pa.RecordBatch.from_arrays([pa.array(at * 2 + k), *(pa.array(m[at, i].astype(np.float64)) for i in range(DIM))], names=["id", *names])

        new = counted.mapInArrow(steps, "id bigint, " + ", ".join(f"{x} double" for x in names)).groupBy("id").agg(*[F.avg(x).alias(x) for x in names]).collect()
        for r in new:
            (v, c)[r["id"] % 2][r["id"] // 2] = [r[x] for x in names]
        old.unpersist()
    return own, v, c


def _add(m: np.ndarray, at: np.ndarray, d: np.ndarray) -> None:
    """m[at] += d with the rows of equal places summed."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    m[s[first]] += np.add.reduceat(d[order], first, axis=0)


class Repairer:
    """Repairs texts by a lexicon and vectors."""

    def __init__(self, words: dict[str, int], own: list[str] = (), v: np.ndarray | None = None, c: np.ndarray | None = None):
        self.words = words
        self.at = {w: i for i, w in enumerate(own)}
        self.v, self.c = v, c
        if len(own):
            self.mean, self.spread = v.mean(axis=0), np.cov(v.T)
        self.common = COMMON * sum(words.values())
        self.prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
        self.by_first: dict[str, list[tuple[str, str]]] = {}
        for seen, meant in GLYPHS:
            self.by_first.setdefault(seen[0], []).append((seen, meant))
        self.memo: dict[str, list[str]] = {}
        self.masked: dict[tuple[str, str], list[str]] = {}  # words with vectors, by what is before and after a letter
        for w in own:
            if len(w) >= LETTERS:
                for i in range(len(w)):
                    self.masked.setdefault((w[:i], w[i + 1 :]), []).append(w)

    def linked(self, word: str) -> list[str]:
        """Frequent words that plausible glyph edits make of a rare word, those with fewest edits first."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            most = 1 if len(word) < 5 else 2 if len(word) < 8 else 4
            found: dict[str, int] = {}
            stack = [(0, "", 0)]
            while stack:
                i, made, edits = stack.pop()
                if made and made not in self.prefixes:
                    continue
                if i == len(word):
                    if made in self.words and edits and found.get(made, 9) > edits:
                        found[made] = edits
                    continue
                if not word[i].isdigit():
                    stack.append((i + 1, made + word[i], edits))
                if edits < most:
                    stack += [(i + len(s), made + m, edits + 1) for s, m in self.by_first.get(word[i], ()) if word.startswith(s, i)]
            least = min(found.values(), default=0)
            self.memo[word] = sorted((w for w, n in found.items() if n == least), key=lambda w: (-self.words[w], w))
        return self.memo[word]

    def suits(self, words: list[str], around: list[str]) -> list[float | None]:
        """By how many deviations each word suits the words around more than all words do on average; None where nothing is known."""
        known = [self.at[w] for w in around if w in self.at]
        if not known:
            return [None] * len(words)
        context = self.c[known].mean(axis=0)
        deviation = max(float(context @ self.spread @ context) ** 0.5, 1e-9)
        return [float((self.v[self.at[w]] - self.mean) @ context) / deviation if w in self.at else None for w in words]

    def _best(self, options: list[str], around: list[str]) -> str:
        """The option whose vector suits the words around best; frequent words come first where nothing is known."""
        if len(options) < 2:
            return options[0]
        return max(zip(self.suits(options, around), options), key=lambda x: (x[0] if x[0] is not None else -9.0) + 0.2 * np.log(self.words[x[1]]))[1]

    def unusual(self, word: str, around: list[str]) -> str | None:
        """The word that differs in one letter and suits the words around far better than words do on average, or None."""
        if len(word) < LETTERS or self.v is None or not word.isalpha():
            return None
        options = list(dict.fromkeys(o for i in range(len(word)) for o in self.masked.get((word[:i], word[i + 1 :]), ()) if o != word))
        best = max(((z, o) for z, o in zip(self.suits(options, around), options) if z is not None), default=None)
        return best[1] if best and best[0] >= SURE else None

    def _furniture(self, lines: list[str]) -> list[bool]:
        out, capital = [], [bool(re.search(r"[^\W\d_]", x)) and x == x.upper() and x != x.lower() for x in lines]
        shouting = all(c for x, c in zip(lines, capital) if len(re.findall(r"[^\W\d_]", x)) > 3)
        for i, x in enumerate(lines):
            t = re.sub(r"\s*[~^¦`¬•]\s*", " ", x).strip()
            last = not any(y.strip() for y in lines[i + 1 :])
            before = next((y.rstrip() for y in reversed(lines[:i]) if y.strip()), "")
            if _FOLIO.fullmatch(t) or _HEAD.fullmatch(t) and len(lines) > 1:
                out.append(True)
            elif _BARE.fullmatch(t):
                out.append(len(lines) > 1 and not (last and t.endswith(".") and before and before[-1] not in ".!?。)"))
            elif len(t) > 1 and _ROMAN.fullmatch(t) or len(t) == 1 and t in "ivx" and len(lines) > 1:
                out.append(len(lines) > 1)
            else:
                out.append(capital[i] and not shouting and len(lines) > 1 and len([w for w in _TOKEN.findall(t) if len(w) > 2 and w.isalpha()]) >= 1 and len(t) > 6)
        return out

    def _word(self, m: re.Match, text: str, hidden: list[tuple[int, int]]) -> str:
        """The repaired form of one token."""
        w = m[0]
        low = w.lower()
        if low in self.words or len(w) < 3 or any(a <= m.start() < b for a, b in hidden):
            return w
        if text[m.start() - 1 : m.start()] in "“\"‘'" and text[m.start() - 1 : m.start()] and text[m.end() : m.end() + 1] in ("”", '"', "’", "'"):
            return w
        letters = sum(c.isalpha() for c in w)
        if not letters or any("一" <= c <= "鿿" for c in w):
            return w
        if (k := re.fullmatch(r"(\d{2,})([^\W\d_]{3,})", w)) and k[2].lower() in self.words and (len(k[2]) > 3 or self.words[k[2].lower()] >= self.common):
            return f"{k[1]} {k[2]}"
        if letters * 2 <= len(w) or letters != len(w) and len(w) < 4:
            return w
        if options := self.linked(low):
            best = self._best(options, _around(text, m))
            if len(w) > 3 or self.words[best] >= 50:
                return _cased(w, best)
        if letters == len(w) and not re.search(r"(?:straße|strasse|weg|gasse|platz)$", low):
            for i in range(2, len(w) - 1):
                a, b = low[:i], low[i:]
                if a in self.words and b in self.words and (w[i].isupper() or min(self.words[a], self.words[b]) >= 10 and (len(a) > 2 or len(b) > 4) and len(b) > 1):
                    return f"{w[:i]} {w[i:]}"
        if letters == len(w) and (best := self.unusual(low, _around(text, m))):
            return _cased(w, best)
        return w

    def repair(self, text: str) -> tuple[str, bool]:
        """(the readable text, whether it is a case)."""
        t = text.replace("\r\n", "\n").replace("\r", "\n")
        found = False
        seen = _TOKEN.findall(t.lower())
        lone_letters = sum(len(w) == 1 for w in seen)
        mixed = not all(w.isalpha() or w.isdigit() for w in seen)
        broken = "-" in t and ("- " in t or "-\n" in t or "-\t" in t) or "¬" in t or "‐" in t
        marked = bool(_MARKS.search(t))
        if not (marked or broken or mixed or "\n" in t or lone_letters > 3 or "l" in seen) and all(w in self.words or w.isdigit() for w in seen):
            return t.rstrip(), False  # nothing that any step below changes
        if "\n" in t:
            lines = t.split("\n")
            bad = self._furniture(lines)
            if any(bad):
                found = True
                t = "\n".join(x for x, b in zip(lines, bad) if not b)
                t = re.sub(r"\n{2,}", "\n", t).strip("\n")
        if marked and _MARKS.search(t):
            # Marks that no formula, list or table explains.
            legit = [m.span() for m in _LEGIT.finditer(t)]
            out, last = [], 0
            for m in _MARKS.finditer(t):
                if m[0] == "¬" and re.match(r"¬[ \t]*\n", t[m.start() : m.start() + 8]) or any(a <= m.start() < b for a, b in legit):
                    continue
                out.append(t[last : m.start()].rstrip(" ") if t[m.end() : m.end() + 1] in (" ", "\n", "") else t[last : m.start()])
                last, found = m.end(), True
            t = "".join([*out, t[last:]])

        def joined(m: re.Match) -> str:
            nonlocal found
            a, gap, b = m[1], m[2], m[3]
            whole = (a + b).lower()
            if whole not in self.words:
                if b.lower() in CONNECTORS or "\n" not in gap and (a.lower() in self.words and b.lower() in self.words):
                    return m[0]
                if b[0].isupper() and not (a.isupper() and len(a) > 1):
                    return m[0]
                if "\n" not in gap and not b[0].islower() and not b.isupper():
                    return m[0]
            found = True
            return a + b

        for _ in range(2 * broken):
            t = _BREAK.sub(joined, t)

        def closed(m: re.Match) -> str:
            nonlocal found
            found = True
            flat = m[0].replace(" ", "")
            # Spaced words in a row are parted where the lexicon allows.
            out, i = [], 0
            while i < len(flat):
                j = next((j for j in range(len(flat), i, -1) if flat[i:j].lower() in self.words and (j - i > 1 or flat[i:j].lower() in "aàyeoиву")), len(flat))
                out.append(flat[i:j])
                i = j
            return " ".join(out)

        if lone_letters > 3:
            t = _SPACED.sub(closed, t)
        if mixed and _NUMBER.search(t):
            hidden = [m.span() for m in _MAIL.finditer(t)]
            fixed = _NUMBER.sub(lambda m: m[0] if any(a <= m.start() < b for a, b in hidden) else m[0].translate(str.maketrans("lIOo", "1100")), t)
            found, t = found or fixed != t, fixed
        if "l" in seen and (lone := re.sub(r"(?<![\w'’.])l(?![\w'’.])", "1", t)) != t:
            found, t = True, lone
        tokens = list(_TOKEN.finditer(t))
        lows = [m[0].lower() for m in tokens]
        strange = [w not in self.words and not w.isdigit() for w in lows]
        if any(strange):
            hidden = [m.span() for m in _MAIL.finditer(t)]
            out, last, skip = [], 0, -1
            for k, m in enumerate(tokens):
                after = k + 1 < len(tokens) and strange[k + 1]
                if k == skip or not (strange[k] or after):
                    continue
                if k + 1 < len(tokens) and t[m.end() : tokens[k + 1].start()] in (" ", "\n") and lows[k].isalpha() and lows[k + 1].isalpha():
                    whole, nxt = lows[k] + lows[k + 1], tokens[k + 1][0]
                    if whole in self.words and len(whole) > 3 and not any(a <= m.start() < b for a, b in hidden) and (nxt[0].islower() or m[0].isupper()):
                        out += [t[last : m.start()], m[0] + nxt]
                        last, skip, found = tokens[k + 1].end(), k + 1, True
                        continue
                if strange[k] and (new := self._word(m, t, hidden)) != m[0]:
                    out += [t[last : m.start()], new]
                    last, found = m.end(), True
            t = "".join([*out, t[last:]])
        return _reflowed(t), found


def _around(text: str, m: re.Match) -> list[str]:
    """Three words on each side of a token, in lower case."""
    return [x.lower() for x in _TOKEN.findall(text[max(0, m.start() - 40) : m.start()])[-3:] + _TOKEN.findall(text[m.end() : m.end() + 40])[:3]]


def _cased(seen: str, word: str) -> str:
    if seen.isupper() and len(seen) > 1:
        return word.upper()
    return word[0].upper() + word[1:] if seen[0].isupper() else word


def _reflowed(text: str) -> str:
    """Lines joined into paragraphs; lists, verse in quotes and blank lines stay."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.strip() if out else line.rstrip()
        keep = re.match(r"(?:\d{1,2}\.|[•*-])\s", line) or out and re.search(r"“[^”]*$", out[-1]) and line[:1].isupper() and len(out[-1]) < 50
        if out and line and out[-1] and not keep:
            out[-1] = f"{out[-1]} {line}"
        else:
            out.append(line)
    return "\n".join(out)


def repair(df: DataFrame, id_col: str, text_col: str, words: dict[str, int], vectors: tuple[list[str], np.ndarray, np.ndarray], counts: dict[int, int], cases_only: bool = False) -> DataFrame:
    """(id_col, text_col, repaired boolean): the readable texts; with `cases_only`, those in need of repair."""
    kind = dict(df.dtypes)[id_col]
    model = df.sparkSession.sparkContext.broadcast((words, *vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, classes = Repairer(*model.value), Classes(counts)
        for batch in batches:
            ids, texts, cases = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new, case = repairer.repair(classes.rewrite(t)) if t else (t, False)
                if case or not cases_only:
                    ids.append(i)
                    texts.append(new)
                    cases.append(case)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(texts, pa.string()), pa.array(cases, pa.bool_())], names=[id_col, text_col, "repaired"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, repaired boolean")
