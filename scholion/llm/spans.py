"""Problem 9: long exact spans shared between records, by difference-cover anchors.

A window of `WINDOW` characters is hashed only where its position modulo the period lies in a
difference cover. Whatever the two offsets of a common span are, some position of it is a cover
position in both records, so every common span of WINDOW + period - 1 = 200 characters shares an
aligned anchor. Anchors that stand in two records or more mark the regions where a span can lie;
there the match is extended: each window of the full length around a shared anchor is hashed
with 96 bits and compared, so that one common span of exactly the least length is found as well.

Hashes travel as packed binary blobs, a few rows per task and bucket, not as a row per position;
positions travel as packed lists, one per record and bucket. Buckets and tasks grow with the
characters of the corpus. An anchor that stands in several records of one map task is known to be
shared there, and only one of them goes on, so a passage of very many records is no hot bucket.
Texts are shuffled only for records with a shared anchor.

Defined results: null, empty and short texts share nothing; equal records give pairs like any
others; rows with the same id count as one record; other columns are ignored; positions are
Unicode code points of the text exactly as stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.runtime import cut

#: The least length of a span.
LENGTH = 200
#: Order of the difference cover: its period is ORDER**2 + ORDER + 1, its size ORDER + 1.
ORDER = 11
#: Entries held by a map task before they are written out.
FLUSH = 1 << 21
#: Characters of the corpus for each task of a shuffle, and buckets of hashes a task.
TASK_CHARS, TASK_BUCKETS = 1 << 22, 4
#: Most bits of the record filter that goes before the join with the texts; with more records there is none.
FILTER_BITS = 1 << 26

_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


@lru_cache
def cover(order: int = ORDER) -> np.ndarray:
    """A perfect difference cover modulo order**2 + order + 1 for a prime order.

    The zeros of a linear recurrence of full period over the integers modulo `order` (Singer).
    """
    period = order * order + order + 1
    for c in range(1, order):
        for b in range(order):
            for a in range(order):
                x, zeros, start = (0, 0, 1), [], (0, 0, 1)
                for i in range(order**3 - 1):
                    if x[0] == 0 and i < period:
                        zeros.append(i)
                    x = (x[1], x[2], (a * x[2] + b * x[1] + c * x[0]) % order)
                    if x == start:
                        break
                if len({(p - q) % period for p in zeros for q in zeros}) == period and len(zeros) == order + 1:
                    return np.array(sorted(zeros))
    raise ValueError("the order must be prime")


class _Roll:
    """Hashes of windows of any length over one run of characters, from one prefix sum."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, base: int = _BASE):
        n = len(codes) + 1
        powers, self.inverse = _Roll.powers.get(base, (np.ones(1, np.uint64),) * 2)
        if len(powers) < n:
            size = 1 << (n - 1).bit_length()
            powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
            _Roll.powers[base] = powers, self.inverse
        x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x *= powers[: n - 1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        x = (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchor_starts(n: int, window: int, order: int) -> np.ndarray:
    """The cover positions of a record of n characters at which a window fits."""
    d = cover(order)
    period = order * order + order + 1
    starts = (np.arange(0, max(n, 1), period)[:, None] + d).ravel()
    return starts[starts + window <= n]


def _batch_rows(ids: list, parts: list[tuple[np.ndarray, ...]], buckets: int) -> pd.DataFrame:
    """A row per bucket: the ids, how many entries each has there, and the entries' hashes, packed.

    Entries are anchors (hashes), or windows (hashes, positions, further bits of the hashes). Anchors
    of several records go on for one of them; rows that are `matched` hold them for all.
    """
    which = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p[0]) for p in parts])
    h, *rest = (np.concatenate(c) for c in zip(*parts))
    own, rows = np.asarray(ids, np.int64), []

    def pack(h: np.ndarray, which: np.ndarray, rest: list[np.ndarray], matched: bool) -> None:
        b = (h % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(b, kind="stable")
        h, which, ends, rest = h[order], which[order], np.searchsorted(b[order], np.arange(buckets + 1)), [x[order] for x in rest]
        for k in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[k], ends[k + 1]
            there, n = np.unique(which[lo:hi], return_counts=True)
            # 48 bits and the bucket tell anchors apart; the extension compares all.
            packed = h[lo:hi].tobytes() if rest else (h[lo:hi] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            rows.append((int(k), matched, np.diff(own[there], prepend=np.int64(0)).astype(np.int64).tobytes(), n.astype(np.uint32).tobytes(), packed, *([x[lo:hi].astype(np.uint32).tobytes() for x in rest] or [b"", b""])))

    if not rest:
        order = np.argsort(h, kind="stable")
        first = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        several = order[(np.bincount(group, minlength=1) > 1)[group]]
        several.sort()
        pack(h[several], which[several], [], True)
        once = np.sort(order[first])
        h, which = h[once], which[once]
    pack(h, which, rest, False)
    return pd.DataFrame(rows, columns=["bucket", "matched", "ids", "n", "hashes", "at", "more"])


_BLOB = "bucket bigint, matched boolean, ids binary, n binary, hashes binary, at binary, more binary"


def _unpack(f: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """(hashes, ids, positions, further bits) of all blobs of a bucket."""
    hashes, ids, rest = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], ([np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)])
    for i, n, h, *more in zip(f["ids"], f["n"], f["hashes"], f["at"], f["more"]):
        raw = np.frombuffer(h, np.uint8).reshape(-1, width)
        full = np.zeros((len(raw), 8), np.uint8)
        full[:, :width] = raw
        hashes.append(full.view(np.uint64).ravel())
        ids.append(np.repeat(np.cumsum(np.frombuffer(i, np.int64)), np.frombuffer(n, np.uint32)))
        for out, x in zip(rest, more):
            out.append(np.frombuffer(x, np.uint32))
    return np.concatenate(hashes), np.concatenate(ids), *map(np.concatenate, rest)


def _shared(h: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of the entries whose hash stands under two ids or more; group numbers rise along the order."""
    if not len(h):
        return (np.zeros(0, np.int64),) * 2
    more = np.zeros(len(h), np.uint32) if more is None else more
    order = np.lexsort((ids, more, h))
    h, ids, more = h[order], ids[order], more[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    keep = (ids[last] != ids[first])[group]
    return order[keep], group[keep]


def _by_bucket(blobs: DataFrame, tasks: int):
    return blobs.repartition(tasks, "bucket").groupBy("bucket")


def shared_anchors(docs: DataFrame, id_col: str, text_col: str, length: int, order: int, tasks: int) -> DataFrame:
    """(id, hashes): for each record its anchors, packed by bucket, that stand in another record too."""
    window, buckets = length - (order * order + order), tasks * TASK_BUCKETS

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or t is None or len(t) < length:
                    continue
                ids.append(i)
                parts.append((np.unique(_Roll(_codes(t)).at(anchor_starts(len(t), window, order), window)),))
                held += len(parts[-1][0])
                if held >= FLUSH:
                    yield pa.RecordBatch.from_pandas(_batch_rows(ids, parts, buckets), preserve_index=False)
                    ids, parts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pandas(_batch_rows(ids, parts, buckets), preserve_index=False)

    def match(f: pd.DataFrame) -> pd.DataFrame:
        b = np.uint64(f["bucket"].iloc[0])
        known, known_ids, *_ = _unpack(f[f["matched"]], 6)
        h, ids, *_ = _unpack(f[~f["matched"]], 6)
        kept, _ = _shared(h, ids)
        h, ids = np.concatenate([h[kept], known]) * np.uint64(buckets) + b, np.concatenate([ids[kept], known_ids])
        o = np.argsort(ids, kind="stable")
        h, ids = h[o], ids[o]
        own, first = np.unique(ids, return_index=True)
        return pd.DataFrame({"id": own, "hashes": [x.tobytes() for x in np.split(h, first[1:])] if len(own) else []})

    # Records of one id are one record: an anchor of two rows of an id alone only costs a look at its text.
    blobs = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(hashed, _BLOB)
    return _by_bucket(blobs, tasks).applyInPandas(match, "id bigint, hashes binary")


def only_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id may be in `ids.id`, by a broadcast bitmap of eight bits a record, up to FILTER_BITS."""
    n = ids.select("id").distinct().count()
    size = 1 << max(16, (8 * n).bit_length())
    if size > FILTER_BITS:
        return docs
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    words = ids.select(bit(F.col("id")).alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 AS int))")).alias("_bits"))
    here = docs.withColumn("_bit", bit(F.col(id_col).cast("long"))).withColumn("_word", F.expr("_bit div 64"))
    return here.join(F.broadcast(words), "_word").where("shiftrightunsigned(_bits, cast(_bit % 64 AS int)) & 1 = 1").drop("_word", "_bit", "_bits")


def _span_blobs(docs: DataFrame, id_col: str, text_col: str, length: int, order: int, tasks: int) -> DataFrame:
    """The hashes of all windows of the full length around shared anchors, as blobs."""
    window, buckets = length - (order * order + order), tasks * TASK_BUCKETS
    anchors = cut(shared_anchors(docs, id_col, text_col, length, order, tasks))
    texts = only_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"), "id", anchors)
    per_doc = anchors.groupBy("id").agg(F.collect_list("hashes").alias("hashes"))

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for i, t, hs in zip(*(batch.column(k).to_pylist() for k in range(3))):
                codes, n = _codes(t), len(t)
                roll = _Roll(codes)
                starts = anchor_starts(n, window, order)
                h = roll.at(starts, window)
                known = np.frombuffer(b"".join(hs), np.uint64)
                cut48 = (h // np.uint64(buckets) & np.uint64(0xFFFFFFFFFFFF)) * np.uint64(buckets) + h % np.uint64(buckets)
                p = starts[np.isin(cut48, known)]
                mark = np.zeros(n + 2, np.int32)
                np.add.at(mark, np.maximum(p + window - length, 0), 1)
                np.add.at(mark, p + 1, -1)
                s = np.flatnonzero(np.cumsum(mark)[: max(n - length + 1, 0)])
                if len(s):
                    ids.append(i)
                    parts.append((roll.at(s, length), s, _Roll(codes, _OTHER).at(s, length) >> np.uint64(32)))
                    held += len(s)
                if held >= FLUSH:
                    yield pa.RecordBatch.from_pandas(_batch_rows(ids, parts, buckets), preserve_index=False)
                    ids, parts, held = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pandas(_batch_rows(ids, parts, buckets), preserve_index=False)

    return texts.join(per_doc, "id").select("id", "text", "hashes").mapInArrow(widened, _BLOB)


def _tasks(docs: DataFrame, text_col: str) -> int:
    """Tasks of a shuffle of hashes, by the characters of the whole corpus."""
    chars = docs.agg(F.sum(F.char_length(text_col).cast("long"))).first()[0] or 0
    return max(4, -(-chars // TASK_CHARS))


def shared_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, order: int = ORDER) -> DataFrame:
    """(doc_a, doc_b): every pair of records, a < b, with a common span of at least `length` characters.

    The rows are as many as such pairs, which no method can go below; `shared_share` is linear.
    """
    block = 512

    def groups(f: pd.DataFrame) -> pd.DataFrame:
        h, ids, _, more = _unpack(f, 8)
        kept, group = _shared(h, ids, more)
        ids = ids[kept]
        seen, out = set(), []
        for g in np.split(ids, np.flatnonzero(np.diff(group)) + 1) if len(ids) else []:
            g = g[np.concatenate([[True], g[1:] != g[:-1]])]
            key = g.tobytes()
            if key not in seen:
                seen.add(key)
                parts = [g[i : i + block].tolist() for i in range(0, len(g), block)]
                out += [(parts[i], parts[j], i == j) for i in range(len(parts)) for j in range(i, len(parts))]
        return pd.DataFrame(out, columns=["a", "b", "same"])

    # The windows of one passage stand under one list of records: lists are made distinct before pairs are.
    tasks = _tasks(docs, text_col)
    lists = _by_bucket(_span_blobs(docs, id_col, text_col, length, order, tasks), tasks).applyInPandas(groups, "a array<bigint>, b array<bigint>, same boolean").distinct()
    pairs = lists.select(F.explode("a").alias("doc_a"), "b").select("doc_a", F.explode("b").alias("doc_b"))
    return pairs.where("doc_a < doc_b").distinct()


def shared_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, order: int = ORDER) -> DataFrame:
    """(id_col, chars, shared_chars, share): how much of each record stands in others; a row for every record."""

    def starts(f: pd.DataFrame) -> pd.DataFrame:
        h, ids, at, more = _unpack(f, 8)
        kept, _ = _shared(h, ids, more)
        ids, at = ids[kept], at[kept]
        o = np.argsort(ids, kind="stable")
        own, first = np.unique(ids[o], return_index=True)
        return pd.DataFrame({"id": own, "at": [x.tobytes() for x in np.split(at[o], first[1:])] if len(own) else []})

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for lists in batch.column(1).to_pylist():
                # Starts of one record, rising: each adds the part of its window that the one before leaves free.
                at = np.unique(np.frombuffer(b"".join(lists), np.uint32)).astype(np.int64)
                n.append(length + int(np.minimum(np.diff(at), length).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["id", "n"])

    tasks = _tasks(docs, text_col)
    packed = _by_bucket(_span_blobs(docs, id_col, text_col, length, order, tasks), tasks).applyInPandas(starts, "id bigint, at binary")
    # The starts of one record are fewer than its characters.
    shared = packed.groupBy("id").agg(F.collect_list("at").alias("at")).mapInArrow(covered, "id bigint, n bigint")
    every = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.coalesce(F.char_length(text_col), F.lit(0))).cast("long").alias("chars"))
    return every.join(shared, "id", "left").select(F.col("id").alias(id_col), "chars", F.coalesce("n", F.lit(0)).alias("shared_chars"), F.round(F.coalesce(F.col("n") / F.col("chars"), F.lit(0.0)), 6).alias("share"))
