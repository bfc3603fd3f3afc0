"""Problem 1: matching entities across sources without keys, by soft-logic linkage.

Descriptions of works (title, people, year, DOI) from any source are normalised; equal ones are
collapsed on both sides, so a work that is described very often is no hot group. Titles are compared
once for each pair of distinct texts. A pair can only agree if every word of the reference's title
has a counterpart in the record's, so a reference looks its records up by its rarest words: triples
of the PLACES rarest, out of all words that some record has, or pairs where it has no more than three. A word that is misspelt on either side
also counts as each more frequent word of the records within one edit (two, where one edit leads
to none and the other is far more frequent), found by deletion neighbourhoods over the distinct words. Records stand under every triple and pair of their words that lie within REACH words of each other.

Each candidate gets graded evidence, and weighted rules over it make a hinge-loss Markov random
field: title and people agree -> same, different part or edition -> not same, years far apart -> not
same, at most one work for a reference (exclusivity), and what is the same as a record is the same
as that record's twin (transitivity, by the evidence of the two records themselves). Its convex
energy is minimised by alternating directions (ADMM): each rule keeps a local copy of its variables,
solved in closed form, and the copies are averaged until they agree. No rule joins variables of two
references, so the problem falls exactly into one block per reference, and blocks are solved in
parallel on the executors. The value of a pair in [0, 1] is its confidence.

Defined results: a reference without a title has no matches (a DOI alone is no proof); null people,
years and DOIs give no evidence for or against; redelivered rows count once; empty tables give no
rows; equal descriptions get equal confidences; columns beside those named are ignored. Titles and
descriptions are told apart by 64-bit signatures.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.lookalikes import Classes
from scholion.runtime import cut

#: Words of a reference by whose tuples it looks records up (the rarest); words of a record that lie so near each other make one.
PLACES, REACH = 4, 8
#: Bits of the filter of the words of references of few words.
WORD_BITS = 1 << 16
#: How much more frequent a word has to be than the one two edits away that it may stand for.
RATIO = 8
#: Longest word that is shortened in every way; longer ones are found by their parts. Letters of forms in a batch.
LONG, LETTERS = 48, 1 << 20
#: Keys of titles in a batch.
KEYS = 1 << 17
#: Words and pairs of words of which a worker remembers letters and edits.
REMEMBERED = 1 << 15
#: Share of the letters that two titles may differ in, and letters on top of it, to be compared word by word.
CHANGED, SLACK = 0.5, 4
#: The least confidence of a match.
MATCH = 0.5
#: Candidates that a worker holds as Python values at a time, numbers in its table of solved blocks and in that of the twins among records.
HELD, SOLVED, ALIKE = 1 << 13, 1 << 20, 1 << 17

# Words that make another work of the same title.
MARKERS = frozenset("reply response critics part revisited further evidence second third edition revised volume vol ed sequel rejoinder supplement appendix ii iii iv".split())
_TAIL = re.compile(r"\.\s+[^.]{4,}?,\s*\d+\s*(?:\(\d+\))?\s*$")
_MARKUP = re.compile(r"<[^>]{1,20}>")
_SUBTITLE = re.compile(r":\s|\s[—–-]\s")
_YEAR = re.compile(r"\d{4}")
_BRACKET = re.compile(r"\s*\[[^\]]{1,40}\]\s*$")
_CUT = ("...", "…", "—", "–", ":", "-")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]")
_IDEOGRAPH = re.compile("([\u3400-\u9fff])")
_GAPS = re.compile(r"[\W_]+")
#: ASCII without what is neither letter nor digit.
_PLAIN = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
_DOI = re.compile(r"10\.\d{4,9}\s*/\s*[^\s\"<>]+")


def fold(text: str) -> str:
    """Letters and digits in lower case without accents, words parted by single blanks."""
    t = text.lower()
    if t.isascii():
        return " ".join(t.replace("&", " and ").translate(_PLAIN).split())
    t = unicodedata.normalize("NFKD", t.replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("ß", "ss"))
    t = _IDEOGRAPH.sub(r" \1 ", _MARKS.sub("", t))
    return _GAPS.sub(" ", t.replace("&", " and ")).strip()


def describe(title: str | None, classes: Classes | None = None) -> tuple[str, int, bool]:
    """(normalised title, words before its subtitle, whether it was cut short)."""
    t = title or ""
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _MARKUP.sub("", t)
    t = (classes.rewrite(t) if classes else t).strip().strip("\"“”«»'")
    if t.endswith("]") or t.endswith("] "):
        t = _BRACKET.sub("", t)
    if t[-1:] in ")0123456789" and ". " in t and len(shorter := _TAIL.sub("", t)) >= 8:
        t = shorter
    flat = fold(t)
    main = _SUBTITLE.search(t)
    return flat, len(fold(t[: main.start()]).split()) if main else flat.count(" ") + bool(flat), t.rstrip().endswith(_CUT)


def identifier(doi: str | None) -> str | None:
    """A DOI in lower case without decoration, or None."""
    d = _DOI.search(html.unescape(doi).lower()) if doi else None
    return re.sub(r"\s", "", d[0]).rstrip(".,;)]") if d else None


def year_of(text: str | None) -> int | None:
    y = _YEAR.search(text) if text else None
    return int(y[0]) if y else None


def people_words(text: str | None, classes: Classes | None = None) -> list[str]:
    """The distinct words of a line of people that can be names, in order."""
    flat = fold(classes.rewrite(text) if classes else text) if text else ""
    return list(dict.fromkeys(w for w in flat.split() if len(w) > 2 and w not in ("and", "others")))


def surnames(people: list[str]) -> list[str]:
    """Surnames of a record's people given as `Given Surname` or `Surname, Given`."""
    out = []
    for p in people:
        first, comma, _ = p.partition(",")
        words = fold(first).split()
        words = [w for w in words if len(w) > 1] or words
        if words:
            out.append(words[0] if comma else words[-1])
    return out


@lru_cache(REMEMBERED)
def _letters(word: str) -> int:
    """The letters of a word as bits, one for the first and one for a second of a kind; several letters may share them."""
    bits = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        bits |= bit << 32 if bits & bit else bit
    return bits


def near(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) between two words, or most + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = _letters(a), _letters(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:  # an edit brings in one letter at most
        return most + 1
    lo, hi, least = 0, 0, min(len(a), len(b))
    while lo < least and a[lo] == b[lo]:
        lo += 1
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    if lo or hi:  # equal ends need no edit
        a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            k = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                k = min(k, before[j - 2] + 1)
            row.append(k)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


#: The same for words that are compared again and again.
_near = lru_cache(REMEMBERED)(near)


@lru_cache(REMEMBERED)
def _reach(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 6 or word.isdigit() else 1 + len(word) // 4


def compare_titles(a: str, b: str) -> tuple[float, float, bool]:
    """(agreement of the aligned words, share of b that is covered, whether b goes on with more than a marker).

    Agreement is 0 where a word of `a` has no counterpart in `b`, or `b` has a word too many before its end.
    """
    if a == b:
        return 1.0, 1.0, False
    x, y = a.split(), b.split()
    lo = 0
    while lo < len(x) and lo < len(y) and x[lo] == y[lo]:
        lo += 1
    # Words in order; small ones (articles, joins) may be missing or changed.
    i = j = lo
    edits, used, extra = 0, sum(map(len, y[:lo])), []
    while i < len(x) and j < len(y):
        v, w = x[i], y[j]
        p, q, far, other = len(v), len(w), _reach(v), _reach(w)
        r = max(far, other)
        # What lengths tell comes first.
        if v == w:
            used, i, j = used + q, i + 1, j + 1
        elif abs(p - q) <= r and (n := _near(v, w, r)) <= r:
            edits, used, i, j = edits + n, used + q, i + 1, j + 1
        elif q < 4 and j + 1 < len(y) and not w.isdigit() and (v == y[j + 1] or _near(v, y[j + 1], far) <= far):
            used, j, edits = used + q, j + 1, edits + 1
        elif p < 4 and i + 1 < len(x) and not v.isdigit() and (x[i + 1] == w or _near(x[i + 1], w, other) <= other):
            i, edits = i + 1, edits + 1
        elif j + 1 < len(y) and abs(p - q - len(y[j + 1])) <= r + 1 and _near(v, w + y[j + 1], r + 1) <= r + 1:
            edits, used, i, j = edits + 1, used + q + len(y[j + 1]), i + 1, j + 2
        elif i + 1 < len(x) and abs(p + len(x[i + 1]) - q) <= r + 1 and _near(v + x[i + 1], w, r + 1) <= r + 1:
            edits, used, i, j = edits + 1, used + q, i + 2, j + 1
        elif len(x[i]) < 4 and len(y[j]) < 4 and not x[i].isdigit() and not y[j].isdigit() and x[i] not in MARKERS and y[j] not in MARKERS:
            edits, used, i, j = edits + 1, used + len(y[j]), i + 1, j + 1
        else:
            return 0.0, used / max(1, sum(map(len, y))), False
    if i < len(x):  # a goes on where b has ended
        rest = x[i:]
        if len(rest) > 1 or len(rest[0]) > 1 or rest[0].isdigit():
            return 0.0, 1.0, False
    rest = y[j:]
    total = sum(map(len, y))
    marker = bool(rest) and sum(any(near(w, m, 1) <= (len(m) > 3) for m in MARKERS) or w.isdigit() or w in ("a", "to", "the") for w in rest) == len(rest)
    agree = max(0.0, 1 - edits / max(4, used))
    return agree, used / max(1, total) if rest else 1.0, bool(rest) and not marker


#: How surely candidates are of one work, as (i, j, value), i < j; other pairs are not.
Twins = tuple[tuple[int, int, float], ...]


class Described(NamedTuple):
    """What a record says of a work; `people` are surnames."""

    title: str
    main: int
    short: bool
    people: list[str]
    year: int | None


def agreement(words: int, short: bool, main: int, t: float, covered: float, more: bool) -> float:
    """Agreement of two titles in [0, 1], from that of their words; 0 where they name different works.

    `words` and `short` are of the first title, `main` of the second.
    """
    if t <= 0 or covered >= 1:
        return t
    if not more and not short or words < 3 and words != main or words < 2:
        return 0.0  # only a marker is missing, or too little is left
    return t * (0.75 if more and (short or words == main) else 0.7 if short else 0.6)


#: The same over columns: words, short, main, t, covered, more.
_AGREEMENT = """CASE WHEN t <= 0 OR covered >= 1 THEN t WHEN (NOT more AND NOT short) OR (words < 3 AND words <> main) OR words < 2 THEN 0D
 ELSE t * CASE WHEN more AND (short OR words = main) THEN 0.75D WHEN short THEN 0.7D ELSE 0.6D END END"""
_YEAR_EVIDENCE = "coalesce(CASE abs(year - other_year) WHEN 0 THEN 1D WHEN 1 THEN 0.7D WHEN 2 THEN 0D ELSE CASE WHEN year IS NULL OR other_year IS NULL THEN 0D ELSE -1D END END, 0D)"
_DOI_EVIDENCE = "CASE WHEN doi IS NULL OR other_doi IS NULL THEN 0D WHEN doi = other_doi THEN 1D ELSE -0.3D END"


def people_agree(a: list[str], b: list[str]) -> float:
    """1 where a word of one side is a surname of the other, give or take some letters, -1 where none is, 0 where a side is empty."""
    if not a or not b:
        return 0.0
    return 1.0 if not set(a).isdisjoint(b) or any(near(w, s, 1 + len(s) // 5) <= 1 + len(s) // 5 for s in b for w in a) else -1.0


def twin_value(a: Described, b: Described) -> float:
    """How surely two records are of one work: 0, or the agreement of their titles where people and years allow it."""
    close = a.year is not None and b.year is not None and abs(a.year - b.year) < 2
    if not close and people_agree(a.people, b.people) < 0:
        return 0.0
    t = max(agreement(x.title.count(" ") + 1, x.short, y.main, *compare_titles(x.title, y.title)) for x, y in ((a, b), (b, a)))
    return round(t, 2) if t >= 0.8 else 0.0


def twins_among(records: list[Described]) -> Twins:
    """The pairs of records that are of one work."""
    return tuple((j, i, same) for i, others in enumerate(_possible(records)) for j in others if j < i and (same := twin_value(records[i], records[j])))


def _possible(records: list[Described]) -> Iterator[Iterable[int]]:
    """For each record those before it, and maybe later ones, whose people or years let them be of its work."""
    if len(records) < 16:
        yield from map(range, range(len(records)))
        return
    of, in_year, nobody = {}, {}, [i for i, r in enumerate(records) if not r.people]
    for i, r in enumerate(records):
        in_year.setdefault(r.year, []).append(i)
        for p in r.people:
            of.setdefault(p, []).append(i)
    names, beside = list(of), {}
    letters, size = np.array([_letters(p) for p in names], np.uint64), np.array([len(p) for p in names])
    most = 1 + size // 5
    for p, x, n in zip(names, letters, size):
        maybe = (np.abs(size - n) <= most) & (np.bitwise_count(letters & ~x) <= most) & (np.bitwise_count(x & ~letters) <= most)
        beside[p] = [names[k] for k in np.flatnonzero(maybe) if near(p, names[k], int(most[k])) <= most[k]]
    for i, r in enumerate(records):
        if not r.people:
            yield range(i)
            continue
        found = {*nobody, *(j for p in r.people for q in beside[p] for j in of[q])}
        if r.year is not None:
            found.update(j for y in (r.year - 1, r.year, r.year + 1) for j in in_year.get(y, ()))
        yield sorted(found)


class Field:
    """A hinge-loss Markov random field: energy = sum of w * max(0, c.y + d), minimised by ADMM over y in [0, 1]."""

    def __init__(self, variables: int):
        self.n, self.rules = variables, []

    def rule(self, weight: float, terms: dict[int, float] | list[tuple[int, float, float]], offset: float) -> None:
        """`terms` are coefficients by variable, or (variable, coefficient, how many such rules each variable of its kind has)."""
        if weight > 0:
            self.rules.append((weight, [(i, c, 1.0) for i, c in terms.items()] if isinstance(terms, dict) else terms, offset))

    def solve(self, rounds: int = 2000, rho: float = 1.0, tolerance: float = 2e-5, starts: list[int] | None = None) -> np.ndarray:
        """Consensus ADMM; every rule's step is the projection of the quadratic onto its hinge.

        Rules are kept as one flat list of (rule, variable, coefficient) entries. `starts` are the first
        variables of blocks that no rule joins: each has the values with which it ends by itself.
        """
        if not self.rules:
            return np.zeros(self.n)
        firsts = np.array(starts or [0])
        block = np.repeat(np.arange(len(firsts)), np.diff([*firsts, self.n]))
        ended, out = np.zeros(len(firsts), bool), np.empty(self.n)
        sizes = np.array([len(t) for _, t, _ in self.rules])
        heads, rule = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
        at = np.fromiter((i for _, t, _ in self.rules for i, _, _ in t), np.int64)
        c, times = (np.fromiter((x[k] for _, t, _ in self.rules for x in t), float) for k in (1, 2))
        d, norm = np.array([r[2] for r in self.rules]), np.add.reduceat(c * c, heads)
        most = np.array([r[0] for r in self.rules]) / rho
        count = np.maximum(np.bincount(at, times, self.n), 1)
        z, u = np.full(self.n, 0.5), np.zeros(len(at))
        live = np.arange(self.n)
        for turn in range(1, rounds + 1):
            v = z[at] - u
            step = np.minimum(np.maximum((np.add.reduceat(c * v, heads) + d) / norm, 0), most)  # inside the hinge, on its edge, or outside
            local = v - c * step[rule]
            new = np.minimum(np.maximum(np.bincount(at, (local + u) * times, len(live)) / count, 0), 1)
            apart = local - new[at]
            u += apart
            if turn % 8:  # whether blocks have ended is seen now and then
                z = new
                continue
            moving = np.zeros(len(firsts), bool)
            moving[block[np.abs(new - z) >= tolerance]] = True
            moving[block[at[np.abs(apart) >= 10 * tolerance]]] = True
            z = new
            if (now := ~moving & ~ended).any():
                out[live[now[block]]] = z[now[block]]
                ended |= now
            if (over := ended[block]).sum() * 4 >= len(live):  # what has ended goes, the rest is renumbered
                keep = ~over
                if not keep.any():
                    return out
                entries, kept = keep[at], keep[at[heads]]
                at, c, u, times = (np.cumsum(keep) - 1)[at[entries]], c[entries], u[entries], times[entries]
                sizes, d, norm, most = sizes[kept], d[kept], norm[kept], most[kept]
                heads, rule = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
                live, z, count, block = live[keep], z[keep], count[keep], block[keep]
        left = ~ended[block]
        out[live[left]] = z[left]
        return out


#: Weights of the rules.
WEIGHTS = {"title": 4.0, "people": 2.0, "doi": 2.0, "no_people": 2.5, "no_year": 2.0, "prior": 1.0, "other_work": 10.0, "exclusive": 3.0, "twin": 3.0}


#: The evidence of a reference's candidates and the twins among them.
Evidence = tuple[tuple[tuple[float, float, float, float], ...], Twins]


def _small(groups: list[Evidence], n: int) -> np.ndarray:
    """The optima of blocks of n = 1 or 2 candidates: the energy is linear between the points where rules begin or end, so one of these is best.

    Where several are, so is their mean.
    """
    t, people, year, doi = np.array([pairs for pairs, _ in groups]).transpose(2, 0, 1)[..., None]
    w, flat = WEIGHTS, np.zeros_like(t)
    points = np.concatenate([flat, t, np.minimum(1, t + 0.2), flat + 1], axis=2)  # (block, candidate, point)
    if n == 2:
        one, two = points[:, 0], points[:, 1]
        same = np.array([twins[0][2] if twins else 0.0 for _, twins in groups])[:, None]
        ends = lambda x: [np.where(same > 0, x + same - 1, 1 - x), np.where(same > 0, x + 1 - same, 1 - x)]  # noqa: E731  # where a rule of both ends
        x = np.concatenate([np.repeat(one, 4, axis=1), one, one, *ends(two)], axis=1)
        y = np.concatenate([np.tile(two, 4), *ends(one), two, two], axis=1)
        points = np.clip(np.stack([x, y], axis=1), 0, 1)
    over = lambda v: np.maximum(0, v)
    energy = (w["prior"] + w["no_people"] * (people < 0) + w["no_year"] * (year < 0)) * points + w["title"] * np.where(t > 0.8, 1.0, 0.4) * over(t - points)
    energy += w["people"] * (people > 0) * over(np.minimum(1, t + 0.2) - points) + (w["doi"] * (doi > 0) + 0.8 * year * (year > 0.5)) * (1 - points)
    energy = energy.sum(axis=1)
    if n == 2:
        x, y = points[:, 0], points[:, 1]
        energy += np.where(same > 0, w["twin"] * (over(x - y + same - 1) + over(y - x + same - 1)), w["exclusive"] * over(x + y - 1))
    best = energy <= energy.min(axis=1, keepdims=True) + 1e-9
    return (points * best[:, None]).sum(axis=2) / best.sum(axis=1, keepdims=True)


def blocks(groups: list[tuple]) -> list[np.ndarray]:
    """Confidences of the candidates of many references, from (their evidence, a matrix of how surely candidates are twins of each other)."""
    return _blocks([(pairs, tuple((i, j, twins[i][j]) for j in range(len(pairs)) for i in range(j) if twins[i][j])) for pairs, twins in groups])


def _blocks(groups: list[Evidence]) -> list[np.ndarray]:
    """The same from lists of twins.

    The blocks share no variable, so one run of ADMM solves all of them side by side; those of one or two candidates need none.
    """
    out: list = [None] * len(groups)
    for n in (1, 2):
        if at := [k for k, (pairs, _) in enumerate(groups) if len(pairs) == n]:
            for k, y in zip(at, _small([groups[k] for k in at], n)):
                out[k] = np.round(y * 200) / 200
    more = [k for k, y in enumerate(out) if y is None]
    for k, y in zip(more, _solved([groups[k] for k in more])):
        out[k] = y
    return out


def kinds(group: Evidence) -> tuple[list[int], list[Counter]]:
    """(the kind of each candidate, by kind how many twins of which kind and value each candidate has).

    Candidates are of one kind where their evidence is equal and their twins are, kind by kind. All rules treat
    them alike, so every step of the solver leaves them equal.
    """
    pairs, twins = group
    number = {e: k for k, e in enumerate(dict.fromkeys(pairs))}
    kind, many = [number[e] for e in pairs], len(number)
    while True:
        beside: dict[int, Counter] = {}
        for i, j, same in twins:
            beside.setdefault(i, Counter())[kind[j], same] += 1
            beside.setdefault(j, Counter())[kind[i], same] += 1
        looks = [(k, frozenset(beside[i].items()) if i in beside else None) for i, k in enumerate(kind)]
        number = {x: k for k, x in enumerate(dict.fromkeys(looks))}
        if len(number) == many:
            own = dict(zip(kind, (beside.get(i, Counter()) for i in range(len(kind)))))
            return kind, [own[k] for k in range(many)]
        kind, many = [number[x] for x in looks], len(number)


def _solved(groups: list[Evidence]) -> list[np.ndarray]:
    """The same by ADMM, for blocks of any size: a variable stands for all candidates of its kind, its rules count as often as each of these has them."""
    every = [kinds(g) for g in groups]
    f, w, at, starts = Field(sum(len(beside) for _, beside in every)), WEIGHTS, 0, []
    for (pairs, _), (kind, beside) in zip(groups, every):
        starts.append(at)
        size = Counter(kind)
        for i, (t, people, year, doi) in enumerate(dict(zip(kind, pairs)).values(), at):
            f.rule(w["prior"], {i: 1.0}, 0.0)
            f.rule(w["title"] * (1.0 if t > 0.8 else 0.4), {i: -1.0}, t)
            if people > 0:
                f.rule(w["people"], {i: -1.0}, min(1.0, t + 0.2))
            if doi > 0:
                f.rule(w["doi"], {i: -1.0}, 1.0)
            if people < 0:
                f.rule(w["no_people"], {i: 1.0}, 0.0)
            if year < 0:
                f.rule(w["no_year"], {i: 1.0}, 0.0)
            if year > 0.5:
                f.rule(0.8 * year, {i: -1.0}, 1.0)
        alike = [Counter() for _ in beside]  # twins of each kind, whatever their value
        for a, own in enumerate(beside):
            for (b, same), n in own.items():
                alike[a][b] += n
                if a == b:
                    f.rule(w["twin"], [(at + a, 1.0, n), (at + a, -1.0, n)], same - 1)
                else:  # once from either side: same as i, and i the same as j: same as j
                    f.rule(w["twin"], [(at + a, 1.0, n), (at + b, -1.0, beside[b][a, same])], same - 1)
        for a in range(len(beside)):
            if alone := size[a] - 1 - alike[a][a]:
                f.rule(w["exclusive"], [(at + a, 1.0, alone / 2), (at + a, 1.0, alone / 2)], -1.0)
            for b in range(a):
                if others := size[b] - alike[a][b]:
                    f.rule(w["exclusive"], [(at + a, 1.0, others), (at + b, 1.0, size[a] - alike[b][a])], -1.0)
        at += len(beside)
    # Evidence has two decimals and optima are sums and halves of it, so what the solver is off is taken back: a pair on the threshold meets it.
    found = np.split(np.round(f.solve(starts=starts) * 200) / 200, starts[1:]) if groups else []
    return [y[kind] for y, (kind, _) in zip(found, every)]


def decided(group: Evidence, values: np.ndarray) -> list[float]:
    """Confidences of a reference's candidates; those that exclusivity leaves on the threshold itself are none beside a better one of another work."""
    (pairs, twins), y = group, values.tolist()
    if len(y) == 1 or MATCH not in y:
        return y
    same = {p for i, j, _ in twins for p in ((i, j), (j, i))}
    better = [j for j, w in enumerate(y) if w >= MATCH]
    return [0.0 if v == MATCH and any((i, j) not in same and pairs[j] > pairs[i] for j in better) else v for i, v in enumerate(y)]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `most` elements of the lists in a column, or one row."""
    ends, lo = batch.column(column).offsets.to_pylist(), 0
    for hi in range(1, batch.num_rows + 1):
        if hi == batch.num_rows or ends[hi + 1] - ends[lo] > most:
            yield batch.slice(lo, hi - lo)
            lo = hi


_DESC = "title string, main int, short boolean, people array<string>, year int, doi string"


def _described(df: DataFrame, counts: dict[int, int], lists: bool) -> DataFrame:
    """(id, description) of (id, title, people, year, doi); `lists` tells records (arrays of people) from references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(counts)
        for batch in batches:
            t, p, y, d = (batch.column(k).to_pylist() for k in range(1, 5))
            titles = [describe(x, classes) for x in t]
            people = [surnames([classes.rewrite(n) for n in x or () if n]) if lists else people_words(x, classes) for x in p]
            columns = [*zip(*titles)] if titles else [()] * 3
            kinds = [pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.string()]
            columns = [*columns, people, [year_of(x) for x in y], [identifier(x) for x in d]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "title", "main", "short", "people", "year", "doi"])

    return df.select("id", "title", "people", "year", "doi").mapInArrow(run, "id bigint, " + _DESC).where("title <> ''")


def shortened(word: str, depth: int) -> set[str]:
    """A word and what is left of it without up to `depth` letters; words within so many edits have one in common."""
    every = last = {word}
    for _ in range(depth if len(word) > 2 and not word.isdigit() else 0):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        every = every | last
    return every


def parts(word: str, depth: int, asks: bool) -> set[str]:
    """Keys of a long word: a word within `depth` edits of an asked one has one of its 2 * depth + 1 even parts (a swap can spoil two), shifted by `depth` letters at most."""
    out = set()
    for n in [len(word)] if asks else range(len(word) - depth, len(word) + depth + 1):
        bounds = [n * k // (2 * depth + 1) for k in range(2 * depth + 2)]
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            for shift in [0] if asks else range(max(-depth, -lo), min(depth, len(word) - hi) + 1):
                out.add(f"{n} {k} {word[lo + shift : hi + shift]}")
    return out


def forms(word: str, depth: int, asks: bool) -> set[str]:
    """Keys of a word, of which an asked word and one within `depth` edits have one in common."""
    if len(word) <= LONG - depth or asks and len(word) <= LONG:
        return shortened(word, depth)
    if asks or len(word) > LONG + depth:
        return parts(word, depth, asks)
    return shortened(word, depth) | parts(word, depth, asks)


def spread(batches: Iterator[pa.RecordBatch], depth: int, asks: bool) -> Iterator[pa.RecordBatch]:
    """(word, df) with the forms of the words, in batches of about LETTERS letters."""
    for batch in batches:
        lo, letters, held = 0, 0, []
        for hi, word in enumerate(batch.column(0).to_pylist(), 1):
            held.append(list(forms(word, depth, asks)))
            letters += len(held[-1]) * len(word)
            if letters > LETTERS or hi == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(held, pa.list_(pa.string()))], names=["word", "df", "left"])
                lo, letters, held = hi, 0, []


def _neighbours(asked: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """(word, option, df): words of `known` (word, df) within `depth` edits of a word of `asked` that are more frequent: at all for one edit, RATIO times for two."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near(x, y, depth) <= depth for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    left, right = (
        df.select("word", "df").mapInArrow(lambda batches, asks=asks: spread(batches, depth, asks), "word string, df bigint, left array<string>").select("word", "df", F.explode("left").alias("left")).withColumn("left", F.xxhash64("left"))
        for df, asks in ((asked, True), (known, False))
    )
    # The forms take a hundred times the room of their words, by which Spark would judge whether to broadcast them.
    right = right.select(F.col("word").alias("option"), F.col("df").alias("option_df"), "left").hint("merge")
    # For one edit it is an order of all words, so that of two such words one always stands for the other.
    more = "(option_df > df OR option_df = df AND option < word)" if depth == 1 else f"option_df > {RATIO} * df"
    pairs = left.join(right, "left").where(f"word <> option AND {more}").select("word", "option", "option_df").distinct()
    return pairs.mapInArrow(verified, "word string, option string, option_df bigint").select("word", "option", F.col("option_df").alias("df"))


#: The words of a title by which it is found: neither small nor, in ideographs, single.
_WORDS = "filter(split(title, ' '), w -> length(w) > 3 OR w RLIKE '[^\\\\x00-\\\\x7f]')"
_TOKENS = """array_distinct(CASE WHEN size(words) = 0 THEN array(replace(title, ' ', ''))
 WHEN size(words) > 1 AND words[0] RLIKE '[^\\\\x00-\\\\x7f]' AND size(words) > length(title) div 4 THEN transform(sequence(0, size(words) - 2), i -> concat(words[i], words[i + 1]))
 ELSE words END)"""


_PLACED = "id bigint, side int, at array<int>, many array<int>, o array<bigint>"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, side, at, o), those of an id one after the other, as one row for each id."""

    def lists(rows: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
        ends, options = np.append(heads, rows.num_rows).astype(np.int32), rows.column(3)
        many = np.diff(options.offsets.to_numpy()).astype(np.int32)
        every = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)[ends]
        columns = [pa.ListArray.from_arrays(pa.array(e), v) for e, v in ((ends, rows.column(2)), (ends, pa.array(many)), (every, options.flatten()))]
        return pa.RecordBatch.from_arrays([*(rows.column(k).take(pa.array(heads)) for k in (0, 1)), *columns], names=["id", "side", "at", "many", "o"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        ids = rows.column(0).to_numpy()
        heads = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
        if len(heads) > 1:  # the last may go on
            yield lists(rows.slice(0, heads[-1]), heads[:-1])
        held = [rows.slice(heads[-1])]
    for rows in held:
        yield lists(rows, np.array([0]))


def _placed(titles: DataFrame) -> DataFrame:
    """(id, side, at, many, o): the words of each title that records have, the rarest first: their places, how many options each has, and the options of all as hashes.

    `side` is 1 where references have the title, 2 where records have it, 3 where both do.

    `titles` has (id, title, asks, has): whether references and whether records have it.
    """
    tokens = cut(titles.withColumn("words", F.expr(_WORDS)).select("id", "asks", "has", F.posexplode(F.expr(_TOKENS)).alias("at", "word")))
    words = cut(tokens.groupBy("word").agg(F.count_if("has").alias("df")))
    known = words.where("df > 0")
    one = cut(_neighbours(words, known, 1))
    lost = words.where("df = 0").join(one.select("word").distinct(), "word", "left_anti")
    every = known.select("word", F.col("word").alias("option"), "df").union(one).union(_neighbours(lost, known, 2))
    # A word has as many options as there are more frequent words within its edits.
    options = cut(every.groupBy("word").agg(F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct((-F.col("df")).alias("n"), F.xxhash64("option").alias("h")))).alias("o"))).select("word", "df", F.expr("o.h").alias("o"))
    side = F.expr("cast(asks AS int) + 2 * cast(has AS int)").alias("side")
    words = tokens.join(options.hint("shuffle_hash"), "word").select("id", side, "at", "o", "df")
    return words.repartition("id").sortWithinPartitions("id", "df", "at").select("id", "side", "at", "o").mapInArrow(_gathered, _PLACED)


#: Factors that tell keys of places and of few words from others.
_SPREAD, _FEW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _tuples(row: np.ndarray, many: np.ndarray, first: np.ndarray, o: np.ndarray, size: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, rows) of `size` words of a row within `reach` words of each other, for every choice of their options; about KEYS at a time.

    `row`, `many` and `first` have of each word its row, how many options it has and where in `o` these begin.
    A key is the exclusive or of the hashes, whatever their order.
    """
    for steps in combinations(range(1, reach), size - 1):
        at = np.arange(max(0, len(row) - steps[-1]))
        at = at[row[at] == row[at + steps[-1]]]
        words = [at, *(at + k for k in steps)]
        counts = np.prod([many[w] for w in words], axis=0, dtype=np.int64)
        ends = np.cumsum(counts)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + KEYS, "right")))
            n = counts[lo:hi]
            which = np.repeat(np.arange(lo, hi), n)
            choice = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            key = np.zeros(len(which), np.uint64)
            for w in words:
                w = w[which]
                key ^= o[first[w] + choice % many[w]]
                choice //= many[w]
            yield key, row[at[which]]
            lo = hi


def _keys(batches: Iterator[pa.RecordBatch], asks: bool, asked_for: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, id, mask) of titles that `_placed` tells of; `asked_for` tells the words of references of few words, by the last bits of their hashes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, at, many, o = batch.column(0).to_numpy(), *(batch.column(k).flatten().to_numpy() for k in (2, 3, 4))
        size, o = np.diff(batch.column(2).offsets.to_numpy()), o.view(np.uint64)
        first, row, heads = np.cumsum(many) - many, np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        bits = np.uint64(1) << (o & np.uint64(63))
        # Of a word with several options the most frequent stands for it.
        mask = np.bitwise_or.reduceat(bits[first] if asks else np.bitwise_or.reduceat(bits, first), heads)
        single = lambda w, by=0: ((o[e := np.concatenate([np.arange(f, f + m) for f, m in zip(first[w], many[w])] or [np.zeros(0, int)])] ^ np.repeat(at[w] + by, many[w]).astype(np.int64).view(np.uint64) * _SPREAD) * _FEW, np.repeat(row[w], many[w]))
        few = lambda found: ((key * _FEW, k) for key, k in found)
        of = lambda w, n, reach: _tuples(row[w], many[w], first[w], o, n, reach)
        if asks:
            n, rank = size[row], np.arange(len(row)) - heads[row]
            alone = np.flatnonzero(n == 1)
            found = chain(of((n > 3) & (rank < PLACES), 3, PLACES), few(of((n > 1) & (n <= 3), 2, PLACES)), (single(alone, by) for by in (-1, 0, 1)))
        else:
            order = np.lexsort((at, row))
            kept = order[np.logical_or.reduceat(asked_for[(o & np.uint64(WORD_BITS - 1)).astype(np.int64)], first)[order]]
            found = chain(of(order, 3, REACH), few(of(kept, 2, REACH)), [single(kept)])
        for key, k in found:
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), ids[k], mask[k].view(np.int64))], names=["key", "id", "mask"])


def _lookups(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, a, asked) of references, (key, b, held) of records); asked and held are 64-bit signatures of the words.

    References of more than three words look up triples of their rarest, others pairs; the few of
    one word, however many they have lost, that word and its place, give or take one.
    """
    # Few references have so few words, and of a record only their words are needed: a bitmap of fixed size tells them.
    short = placed.where("side % 2 = 1 AND size(at) <= 3").select(F.explode("o").alias("h")).select(F.pmod("h", F.lit(WORD_BITS)).alias("bit"))
    asked_for = np.zeros(WORD_BITS, bool)
    for r in short.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits")).collect():
        asked_for[r["word"] * 64 : r["word"] * 64 + 64] = [r["bits"] >> k & 1 for k in range(64)]
    one, other = (placed.where(side).mapInArrow(lambda batches, asks=asks: _keys(batches, asks, asked_for), "key bigint, id bigint, mask bigint") for side, asks in (("side % 2 = 1", True), ("side > 1", False)))
    return one.select("key", F.col("id").alias("a"), F.col("mask").alias("asked")), other.select("key", F.col("id").alias("b"), F.col("mask").alias("held"))


def title_pairs(titles: DataFrame) -> DataFrame:
    """(a, b, t, covered, more): the pairs of a reference's and a record's title whose words agree, equal ones included.

    `titles` (id, title, asks, has) are distinct, so no key is hot by copies; words that many titles
    have are in nobody's rarest, and what a reference's rarest words share is told by the masks
    before a pair leaves the join.
    """
    alike = "a <> b AND 2 * bit_count(asked & ~held) < greatest(bit_count(asked), 1)"
    one, other = _lookups(cut(_placed(titles)))
    # The keys take many times the room of their words, by which Spark would judge whether to broadcast them.
    pairs = one.hint("merge").join(other, "key").where(alike).select("a", "b").distinct()
    texts = titles.select("id", "title")
    # The texts are distinct: they make even hash tables, and no side is sorted.
    one, two = (texts.select(F.col("id").alias(i), F.col("title").alias(t)).hint("shuffle_hash") for i, t in (("a", "x"), ("b", "y")))
    wide = pairs.join(one, "a").join(two, "b")
    most = f"cast(length(x) * {CHANGED}D + {SLACK} AS int)"
    wide = wide.where("length(y) + 2 >= length(x) * 0.7D")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, *e) for k, (p, q) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3)))) if (e := compare_titles(p, q))[0] > 0]
            at, *columns = list(zip(*found)) if found else [()] * 4
            columns = [pa.array(c, k) for c, k in zip(columns, [pa.float64(), pa.float64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, *columns], names=["a", "b", "x", "y", "t", "covered", "more"])

    # Most pairs end at their first words, so letters are counted where words agree.
    compared = wide.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, x string, y string, t double, covered double, more boolean")
    compared = compared.where(f"levenshtein(x, left(y, length(x)), {most}) >= 0").drop("x", "y")
    equal = titles.where("asks AND has").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("t"), F.lit(1.0).alias("covered"), F.lit(False).alias("more"))
    return cut(equal.union(compared))


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solved: dict[Evidence, list[float]] = {}  # equal evidence gives equal confidences
    alike: dict[tuple[int, ...], Twins] = {}  # the records of a title meet again in each of its references
    numbers = remembered = 0
    for whole in batches:
        for batch in slices(whole, 1, HELD):
            if remembered > ALIKE:
                alike.clear()
                remembered = 0
            sigs, lists, more = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            # Offsets count from the start of the whole batch's values.
            ends, more_ends = lists.offsets.to_pylist(), more.offsets.to_pylist()
            first, more_first = ends[0], more_ends[0]
            ends, more_ends = [k - first for k in ends], [k - more_first for k in more_ends]
            held, more_held = lists.values.slice(first, ends[-1]), more.values.slice(more_first, more_ends[-1])
            t, people, year, doi, works, names, surnames_ = (held.field(k).to_pylist() for k in range(7))
            people = [p if p is not None else people_agree(x.split(), y.split()) for p, x, y in zip(people, names, surnames_)]
            records = list(map(Described._make, zip(*(more_held.field(k).to_pylist() for k in range(5)))))
            asked: list[tuple[int, list[int], Evidence]] = []
            evidence = list(zip(t, people, year, doi))
            for k, sig in enumerate(sigs):
                lo, n = ends[k], ends[k + 1] - ends[k]
                if n == 1:
                    asked.append((sig, [works[lo]], ((evidence[lo],), ())))
                    continue
                order = sorted(range(lo, lo + n), key=works.__getitem__)
                ids = tuple(works[i] for i in order)
                if ids not in alike:
                    alike[ids] = twins_among([records[more_ends[k] + i - lo] for i in order])
                    remembered += n + 3 * len(alike[ids])
                # In the order of the evidence, so that equal evidence meets again.
                by = sorted(range(n), key=lambda i: evidence[order[i]])
                place = {i: p for p, i in enumerate(by)}
                twins = sorted((*sorted((place[i], place[j])), same) for i, j, same in alike[ids])
                asked.append((sig, [ids[i] for i in by], (tuple(evidence[order[i]] for i in by), tuple(twins))))
            new = list({e: None for _, _, e in asked if e not in solved})
            solved.update((e, decided(e, v)) for e, v in zip(new, _blocks(new)))
            numbers += sum(6 * len(e[0]) + 3 * len(e[1]) for e in new)
            out = [(sig, work, round(v, 4)) for sig, ids, e in asked for work, v in zip(ids, solved[e]) if v >= MATCH]
            if numbers > SOLVED:
                solved.clear()
                numbers = 0
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.float64()])], names=["sig", "work", "confidence"])


def link(refs: DataFrame, records: DataFrame, counts: dict[int, int]) -> DataFrame:
    """(ref_id, work_id, confidence) for refs (id, title, people string, year, doi) and records (id, title, people array, year, doi)."""
    # Equal descriptions are matched once, under their 64-bit signature.
    same = ["title", "main", "short", "people", "year", "doi"]
    sides = []
    for df, lists in ((refs, False), (records, True)):
        every = _described(df, counts, lists).withColumns({"sig": F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in same]), "tid": F.xxhash64("title")})
        members = cut(every)
        sides.append((members.select("id", "sig").distinct(), members.drop("id").distinct(), members.select("title")))
    (ref_ids, one, asked_titles), (work_ids, works, held_titles) = sides
    both = asked_titles.withColumns({"asks": F.lit(True), "has": F.lit(False)}).union(held_titles.withColumns({"asks": F.lit(False), "has": F.lit(True)}))
    titles = cut(both.groupBy("title").agg(F.bool_or("asks").alias("asks"), F.bool_or("has").alias("has")).withColumn("id", F.xxhash64("title")))
    pairs = title_pairs(titles)
    other = works.select(F.col("tid").alias("b"), F.col("sig").alias("work"), F.col("title").alias("other_title"), "main", F.col("short").alias("other_short"), F.col("people").alias("other_people"), F.col("year").alias("other_year"), F.col("doi").alias("other_doi"))
    asked = one.select("sig", "tid", F.expr("size(split(title, ' '))").alias("words"), "short", "people", "year", "doi")
    both = asked.join(pairs.withColumnRenamed("a", "tid"), "tid").join(other, "b")
    exact = F.when((F.size("people") == 0) | (F.size("other_people") == 0), 0.0).when(F.arrays_overlap("people", "other_people"), 1.0)
    judged = both.withColumns({"t": F.round(F.expr(_AGREEMENT), 2), "by_people": exact, "by_year": F.expr(_YEAR_EVIDENCE), "by_doi": F.expr(_DOI_EVIDENCE)}).where("t > 0")
    # Misspelt names are left to Python; what records say is only needed where there are several.
    names = F.when(F.col("by_people").isNull(), F.concat_ws(" ", "people"))
    light = F.struct("t", "by_people", "by_year", "by_doi", "work", names.alias("names"), F.when(F.col("by_people").isNull(), F.concat_ws(" ", "other_people")).alias("surnames"))
    full = F.struct(F.col("other_title").alias("title"), "main", F.col("other_short").alias("short"), F.col("other_people").alias("people"), F.col("other_year").alias("year"))
    # A reference has as many candidates as there are different records of its title: a bounded group of distinct works.
    grouped = judged.groupBy("sig").agg(F.collect_list(F.struct(light.alias("c"), full.alias("d"))).alias("g")).select("sig", F.expr("g.c").alias("c"), F.expr("CASE WHEN size(g) > 1 THEN g.d ELSE array() END").alias("d"))

    matched = grouped.mapInArrow(solve, "sig bigint, work bigint, confidence double")
    to_works = matched.join(work_ids.select(F.col("id").alias("work_id"), F.col("sig").alias("work")), "work")
    return ref_ids.withColumnRenamed("id", "ref_id").join(to_works, "sig").select("ref_id", "work_id", "confidence").distinct()
