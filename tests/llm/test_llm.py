"""Operators for training data: brute force, round trips, defined results of odd input."""

from __future__ import annotations

import os
import random
import re
from collections import defaultdict

import pytest

from scholion.llm import graph, linkage, lookalikes, packing, personal, queries, residue, scanned, spans, splitting, sql, tokens
from tests.compare import canonical, oracle_rows

DATA = "/root/testdata/sf0.001"
RANKS = os.path.exists(tokens.DEFAULT_RANKS)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# 1. Linkage

REFS = "id long, title string, people string, year string, doi string"
WORKS = "id long, title string, people array<string>, year string, doi string"
CATALOG = [
    (100, "Public Pottery and Ownership in Inchholm", ["Rhosyn Voskova"], "2011", "10.5555/a"),
    (101, "PUBLIC POTTERY &amp; OWNERSHIP IN INCHHOLM", ["Voskova, R."], None, None),
    (102, "Public Pottery and Ownership in Inchholm: A Reply", ["Rhosyn Voskova"], "2014", None),
    (103, "<i>Silent Literacy in Ulvhain</i>", ["Ulla Dorn"], "1999", "10.5555/b"),
    (104, None, None, None, None),
    (103, "<i>Silent Literacy in Ulvhain</i>", ["Ulla Dorn"], "1999", "10.5555/b"),
]


def links(spark, refs, works=CATALOG):
    return {(r["ref_id"], r["work_id"]) for r in linkage.link(frame(spark, refs, REFS), frame(spark, works, WORKS), {}).collect()}


def test_linkage_of_titles_misspelt_in_most_words(spark):
    refs = [
        (1, "Pubilc Potttery and Ownreship in Inchhlm", None, None, None),
        (2, "Silnt Litteracy in Ulvhian", None, None, None),
        (3, "Quiett", None, None, None),
        (4, "Crtics and Repsonse", None, None, None),
        (5, "Meausring Gardns", None, None, None),
    ]
    works = [*CATALOG, (105, "Quiet", None, None, None), (106, "Critics and Response", None, None, None), (107, "Measuring Gardens of Ilverkeld and Some Extraordinarily Complicated Circumnavigations Misinterpreted Throughout Mediterranean", None, None, None)]
    works += [(200 + k, f"Critics and Response {w}", None, None, None) for k, w in enumerate("".join(chr(97 + (i * k) % 26) for k in range(1, 8)) for i in range(1, 16))]
    got = links(spark, refs, works)
    assert {(1, 100), (1, 101), (2, 103), (3, 105), (4, 106)} <= got and not got & {(1, 102), (2, 100), (4, 200)}


def test_title_pairs_equal_brute_force(spark):
    random.seed(4)
    words = "pottery ownership silent literacy measuring gardens quarantine orchard heraldry census village printing harbour masonry".split()
    records = {" ".join(random.sample(words, k=random.randint(2, 6))) for _ in range(60)} | {"of it", "quiet", "архив и память", "国 家 档 案 馆"}

    def damaged(t):
        out = []
        for w in t.split():
            k = random.randrange(len(w))
            out.append(w if random.random() < 0.7 or len(w) < 6 else random.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + "q" + w[k + 1 :]]))
        return " ".join(out)

    asked = {damaged(t) for t in sorted(records) for _ in range(3)} | {"quiett", "unheard words altogether", "国 家 档 案"}
    rows = [(i, t, t in asked, t in records) for i, t in enumerate(sorted(asked | records))]
    ids = {t: i for i, t, _, _ in rows}
    got = {(r["a"], r["b"]) for r in linkage.title_pairs(frame(spark, rows, "id long, title string, asks boolean, has boolean")).collect()}
    every = {(ids[x], ids[y]) for x in asked for y in records if linkage.compare_titles(x, y)[0] > 0}
    assert len(every) > 150 and got <= every and len(got) >= 0.98 * len(every)


def test_long_words_are_found_by_few_keys():
    random.seed(3)
    for n in [46, 47, 48, 49, 50, 51, 60, 3000] * 40:
        w = v = "".join(random.choice("abcdef") for _ in range(n))
        for _ in range(random.randint(0, 2)):
            k = random.randrange(len(v))
            v = random.choice([v[:k] + v[k + 1 :], v[:k] + "z" + v[k:], v[:k] + "z" + v[k + 1 :], v[:k] + v[k + 1 : k + 2] + v[k : k + 1] + v[k + 2 :]])
        keys, others = linkage.forms(w, 2, True), linkage.forms(v, 2, False)
        assert len(others) < 1500 and sum(map(len, others)) < 100_000
        if n > 100 or linkage.near(w, v, 2) <= 2:
            assert keys & others


def test_neighbours_are_not_broadcast(spark):
    words = frame(spark, [("quiet", 90), ("quiett", 0), ("harbour", 80), ("harbuor", 1), ("orchard", 9)], "word string, df long")
    found = linkage._neighbours(words, words.where("df > 0"), 2)
    assert {(r["word"], r["option"], r["df"]) for r in found.collect()} == {("quiett", "quiet", 90), ("harbuor", "harbour", 80)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_batches_are_cut_by_their_candidates(spark):
    import pyarrow as pa

    lists = [[1] * n for n in (3, 900, 0, 40, 40, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.int64()))], names=["sig", "c"])
    cut = list(linkage.slices(batch, 1, 100))
    assert [b.column(0).to_pylist() for b in cut] == [[0], [1], [2, 3, 4], [5]] and [x for b in cut for x in b.column(1).to_pylist()] == lists
    held, linkage.HELD = linkage.HELD, 3
    try:  # cut between the references of a batch, the links are the same
        refs = [(i, t, "R. Voskova", "2011", None) for i, t in enumerate(["Public Pottery and Ownership in Inchholm", "Silent Literacy in Ulvhain", "Public Pottery and Ownrship in Inchholm"] * 3)]
        few = links(spark, refs)
    finally:
        linkage.HELD = held
    assert few == links(spark, refs) and {(i, w) for i in (0, 2, 6) for w in (100, 101)} <= few


def test_linkage(spark):
    refs = [
        (1, "Public Pottery and Ownership in Inchholm", "R. Voskova", "2011", None),
        (2, "Pubilc Pottery and Ownrship in Inchholm. Journal of Clay, 4(2)", "Voskova, R.", "2012", None),
        (3, "Public Pottery and Ownership in Inchholm: A Reply", "R. Voskova", "2014", "10.5555/a"),
        (4, "Public Pottery and Ownership …", "Voskova", "2011", None),
        (5, "Another Work Altogether in Ganhain", "U. Dorn", "1999", "10.5555/b"),
        (6, None, "R. Voskova", "2011", "10.5555/a"),
        (7, "", None, None, None),
        (1, "Public Pottery and Ownership in Inchholm", "R. Voskova", "2011", None),
        (8, "“silent literacy in ulvhain” [Book]", None, None, None),
    ]
    got = links(spark, refs)
    assert {(1, 100), (1, 101), (2, 100), (2, 101), (3, 102), (4, 100), (4, 101), (8, 103)} == got
    assert links(spark, [], CATALOG) == set() and links(spark, refs, []) == set()


def test_admm_reaches_the_optimum():
    f = linkage.Field(2)
    f.rule(3.0, {0: -1.0}, 1.0)
    f.rule(2.0, {1: -1.0}, 1.0)
    f.rule(9.0, {0: 1.0, 1: 1.0}, -1.0)
    y = f.solve(rounds=2000)
    grid = [(a / 50, b / 50) for a in range(51) for b in range(51)]
    energy = lambda a, b: 3 * max(0, 1 - a) + 2 * max(0, 1 - b) + 9 * max(0, a + b - 1)
    assert energy(*y) <= min(energy(a, b) for a, b in grid) + 0.05


def test_blocks_end_at_their_own_optimum():
    random.seed(7)
    alone = [[(t / 100, p, y, 0.0)] for t in range(30, 101, 5) for p in (0.0, 1.0, -1.0) for y in (0.0, 1.0, -1.0)]
    groups = [(tuple(e), ((0.0,),)) for e in alone]
    for n in (2, 3, 4):
        for _ in range(40):
            same = [[0.0] * n for _ in range(n)]
            for i in range(n):
                for j in range(i):
                    same[i][j] = same[j][i] = random.choice([0.0, 1.0, 0.93])
            pairs = tuple((random.choice([1.0, 0.95, 0.75, 0.6, 0.5]), random.choice([0.0, 1.0, -1.0]), random.choice([0.0, 0.7, 1.0, -1.0]), 0.0) for _ in range(n))
            groups.append((pairs, tuple(map(tuple, same))))
    got = linkage.blocks(groups)
    assert all((a == b).all() for a, b in zip(got, (linkage.blocks([g])[0] for g in groups)))  # whatever else is in the batch
    for (((t, people, year, _),), _), y in zip(groups, got[: len(alone)]):  # one candidate: the best of the few points where a rule begins or ends
        at = lambda v: v + (4 if t > 0.8 else 1.6) * max(0, t - v) + 2 * (people > 0) * max(0, min(1, t + 0.2) - v) + (2.5 * (people < 0) + 2 * (year < 0)) * v + 0.8 * (year > 0.5) * (1 - v)
        assert abs(y[0] - min((0, t, min(1, t + 0.2), 1), key=at)) < 1e-6
    assert linkage.blocks([(((0.5, 0.0, 0.0, 0.0),), ((0.0,),))])[0][0] >= linkage.MATCH


def test_titles_whose_two_rarest_words_are_misspelt_on_either_side(spark):
    pairs = [
        ("malmminster and the privacy of oral marginalia", "malmmminster and the prvaacy of oral marginalia"),
        ("medicine humour and thhe oral turn in lundund", "medicine humour and the moral turn in lundsund"),
        ("ecriture de ormmere essai sur la peche et akerwich 1481", "ecriture de ormmree esssai sur la peche et akerwihc 1481"),
    ]
    other = [f"{a} {b} oral moral medicine marginalia" for a in ("ormmere", "akerwich", "privacy", "lundund") for b in ("gardens", "census", "heraldry")]
    titles = [x for p in pairs for x in p] + other
    rows = [(i, t, i % 2 == 0 and i < 6, i % 2 == 1 or i >= 6) for i, t in enumerate(titles)]
    got = {(r["a"], r["b"]) for r in linkage.title_pairs(frame(spark, rows, "id long, title string, asks boolean, has boolean")).collect()}
    assert got >= {(0, 1), (2, 3), (4, 5)}


def test_candidates_of_one_kind_share_a_variable(monkeypatch):
    random.seed(9)
    w, groups, sizes, rules = linkage.WEIGHTS, [], [3, 5, 8, 12, 150], []
    for n in sizes:
        evidence = [(t, p, y, 0.0) for t, p, y in ((0.75, -1.0, -1.0), (0.75, 0.0, 0.7), (1.0, 1.0, -1.0))]
        pairs = tuple(random.choice(evidence) for _ in range(n))
        same = [[0.0] * n for _ in range(n)]
        for _ in range(1 + n // 15):
            i, j = random.sample(range(n), 2)
            same[i][j] = same[j][i] = 0.95
        groups.append((pairs, tuple(map(tuple, same))))
    solve = linkage.Field.solve
    monkeypatch.setattr(linkage.Field, "solve", lambda f, **k: rules.append(len(f.rules)) or solve(f, **k))
    got = [linkage.blocks([g])[0] for g in groups]
    assert rules[-1] < 1000  # 11,000 where each candidate has a variable of its own
    for (pairs, same), y in zip(groups[:-1], got):
        f = linkage.Field(len(pairs))
        for i, (t, people, year, _) in enumerate(pairs):
            rule = [(w["prior"], 1.0, 0.0), (w["title"] * (1.0 if t > 0.8 else 0.4), -1.0, t), (w["people"] * (people > 0), -1.0, min(1.0, t + 0.2)), (w["no_people"] * (people < 0), 1.0, 0.0), (w["no_year"] * (year < 0), 1.0, 0.0), (0.8 * year * (year > 0.5), -1.0, 1.0)]
            for weight, c, d in rule:
                f.rule(weight, {i: c}, d)
            for j in range(i):
                if same[i][j]:
                    f.rule(w["twin"], {i: 1.0, j: -1.0}, same[i][j] - 1)
                    f.rule(w["twin"], {j: 1.0, i: -1.0}, same[i][j] - 1)
                else:
                    f.rule(w["exclusive"], {i: 1.0, j: 1.0}, -1.0)
        assert abs(f.solve() - y).max() < 0.006


def test_twins_are_sought_where_people_or_years_allow_them(monkeypatch):
    random.seed(10)
    name = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(7))
    records = [linkage.Described(f"pages in early printing {name()}", 4, False, [name() for _ in range(random.randint(0, 2))], random.choice([None, *range(1900, 2020)])) for _ in range(60)]
    for r in records[:20]:  # misspelt in title or people, or a year later
        records.append(r._replace(title=r.title[:-1], people=[p[1:] for p in r.people], year=r.year and r.year + random.choice([1, 9])))
    every = {(j, i, v) for i in range(len(records)) for j in range(i) if (v := linkage.twin_value(records[i], records[j]))}
    compared, value = [], linkage.twin_value
    monkeypatch.setattr(linkage, "twin_value", lambda a, b: compared.append(1) or value(a, b))
    assert set(linkage.twins_among(records)) == every and len(every) >= 20 and len(compared) < 0.8 * len(records) * (len(records) - 1) / 2


def test_keys_of_words_equal_brute_force():
    from itertools import combinations, product

    import numpy as np
    import pyarrow as pa

    random.seed(11)
    rows = [[[random.getrandbits(63) for _ in range(random.randint(1, 3))] for _ in range(random.randint(1, 12))] for _ in range(40)]
    words = [(k, o) for k, row in enumerate(rows) for o in row]
    many = np.array([len(o) for _, o in words])
    flat = np.array([h for _, o in words for h in o], np.uint64)
    held, linkage.KEYS = linkage.KEYS, 50
    try:
        for size, reach in ((2, 4), (3, 4), (2, 8), (3, 8)):
            got = sorted((int(r), int(h)) for keys, at in linkage._tuples(np.array([k for k, _ in words]), many, np.cumsum(many) - many, flat, size, reach) for h, r in zip(keys, at))
            expected = []
            for k, row in enumerate(rows):
                for at in combinations(range(len(row)), size):
                    if at[-1] - at[0] < reach:
                        for choice in product(*(row[i] for i in at)):
                            key = 0
                            for h in choice:
                                key ^= h
                            expected.append((k, key))
            assert got == sorted(expected)
    finally:
        linkage.KEYS = held
    # Rows of an id are gathered across batches.
    table = pa.table({"id": pa.array([k for k, _ in words], pa.int64()), "side": pa.array([3] * len(words), pa.int32()), "at": pa.array(range(len(words)), pa.int32()), "o": pa.array([o for _, o in words], pa.list_(pa.int64()))})
    got = [r for b in linkage._gathered(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert [r["id"] for r in got] == list(range(len(rows))) and [r["o"] for r in got] == [[h for o in row for h in o] for row in rows] and [r["many"] for r in got] == [[len(o) for o in row] for row in rows]


# 2. Scanned pages

WORDS = {w: 100 for w in "the quiet modern house of reading was reported by writers in ulvhain hygiene and so it carried on across several parishes near both files survive".split()}


@pytest.mark.parametrize(
    "text, case",
    [
        ("The quiet hy-\ngiene was reported.", True),
        ("The rnodern h0use was repor¬\nted.", True),
        ("The quiet ^ house", True),
        ("The quiethouse of reading", True),
        ("The r e a d i n g house", True),
        ("The quiet\n\n· 212 ·\n\nhouse", True),
        ("The quiet\nSilent Reading in Ulvhain · 14\nhouse", True),
        ("Between l847 and 1850", True),
        ("The quiet\nhouse was\nreported.", False),
        ("The pre- and postwar files survive.", False),
        ("Order:\n1. reading\n2. hygiene", False),
        ("The codes a1b7 and k9x; R2, t0, B12; P(loss|reading) near ~30 kg", False),
        ("It was reported (writers,\n1999).", False),
        ("", False),
    ],
)
def test_scanned(text, case):
    assert scanned.Repairer(WORDS).repair(text)[1] is case


def test_scanned_text_reads_on():
    fixed, _ = scanned.Repairer(WORDS).repair("The rnodern hy-\ngiene\n\n[212]\n\nof read- ing was\nrep0rted.")
    assert fixed == "The modern hygiene of reading was reported."


def test_skip_grams_tell_contexts_apart(spark):
    random.seed(1)
    texts = [f"the {random.choice(['red', 'blue', 'green'])} paint dries" for _ in range(400)] + [f"we {random.choice(['run', 'walk', 'march'])} to town" for _ in range(400)]
    df = frame(spark, [(t,) for t in texts] + [(None,), ("",)], "text string")
    words = scanned.frequent(df, "text")
    own, v, c = scanned.skip_grams(df, "text", words)
    at = {w: i for i, w in enumerate(own)}
    assert v[at["red"]] @ c[at["paint"]] > v[at["run"]] @ c[at["paint"]]
    assert scanned.skip_grams(df.where("false"), "text", {})[0] == []


def test_vectors_decide_between_corrections_and_accept_unusual_ones():
    import numpy as np

    words = {w: 500 for w in "paint wall colour march soldier battle burn barn garden".split()}
    own = list(words)
    v = np.array([[3, 0] if w in ("paint", "wall", "colour", "garden", "barn") else [0, 3] for w in own], float)
    r = scanned.Repairer(words, own, v, v)
    assert r._best(["burn", "barn"], ["paint", "wall"]) == "barn" and r._best(["burn", "barn"], ["battle", "soldier"]) == "burn"
    many = {**words, **{f"filler{i}": 500 for i in range(60)}}
    own = list(many)
    rng = np.random.default_rng(1)
    v = np.array([[3, 0] if w in ("paint", "wall", "colour", "garden") else [0, 3] if w in ("soldier", "battle", "march") else list(rng.normal(size=2) * 0.3) for w in own], float)
    with_vectors, without = scanned.Repairer(many, own, v, v), scanned.Repairer(many)
    text = "paint the wall with colour gaxden paint wall"
    assert with_vectors.repair(text) == ("paint the wall with colour garden paint wall", True)
    assert without.repair(text)[1] is False and with_vectors.repair("march to battle gaxden battle march")[1] is False


# 3. Residue


RESIDUE = "check_id long, page_title string, cited_title string, url string"


def test_residue(spark):
    real = [f"Silent {w} in Ulvhain and After" for w in "reading pottery gardens ownership measuring credit harbour ledger training masonry census weather".split()]
    rows = [(k, f"{t} | Ulvhain Review", t, f"https://h{k}.example/{k}") for k, t in enumerate(real)]
    cases = ["{{ title }}", "Real Work of Reading - %SITENAME%", "404 Not Found", "Untitled-8", "null | Ulvhain Review", "Please enable JavaScript", "Please enable JavaScript!", "Loading…", "Please enable JavaScripts", "Page Not Found | Another Site"]
    content = ["404 Days at Sea: the Industrial Chess of Ilverkeld", "Access Denied: Rethinking Evidence in Ulvrigg and After", "Ulvhain Review", "Silent Reading", None, "", "  "]
    rows += [(100 + k, t, "A Work Cited by Title", "https://x.example") for k, t in enumerate(cases)]
    rows += [(200 + k, t, None, "https://y.example") for k, t in enumerate(content)]
    # Never once the cited title, on many hosts: no phrase is known, but chance is ruled out.
    rows += [(300 + k, "Valet machina, redi cras", f"{t} volume {k}", f"https://h{k}.example/x") for k, t in enumerate(real * 8)]
    rows += [(500 + k, "Valet machina, redi cras." if k else "Valet machina, redi crass", "A Work Cited by Title", "https://z.example") for k in range(2)]
    got = residue.labelled(frame(spark, [*rows, *rows[:40]], RESIDUE))
    how = {r["check_id"]: r["how"] for r in got.collect()}
    assert got.count() == len(how)
    assert set(how) == {100 + k for k in range(len(cases))} | {300 + k for k in range(96)} | {500, 501}
    assert how[100] == "slot" and how[102] == "seed" and how[108] == "link" and how[300] == "evidence" and how[500] == "link"
    assert residue.find(frame(spark, [], RESIDUE)).count() == 0


def test_near_links_are_every_pair_of_the_similarity(spark):
    random.seed(4)
    words = "silent reading pottery gardens ownership measuring digital credit harbour ledger moral training".split()
    cores = set()
    for _ in range(60):
        t = " ".join(random.sample(words, 5))
        cores |= {t, t + "s", t[:7] + "x" + t[7:], t[:-6], t.replace("e", "a", 1)}
    wanted = set()
    for a in cores:
        for b in cores:
            x, y = residue.trigrams(a), residue.trigrams(b)
            if a < b and len(x & y) >= residue.SIMILARITY * len(x | y):
                wanted.add((a, b))
    far = [p for p in wanted if bin(residue.simhash(residue.gram_hashes(p[0])) ^ residue.simhash(residue.gram_hashes(p[1]))).count("1") > residue.HAMMING]
    assert far and {tuple(r) for r in residue.near_links(frame(spark, [(c,) for c in cores], "core string")).collect()} == wanted


def test_simhash_tables_find_every_near_pair():
    random.seed(2)
    for blocks, choose in ((8, 2), (9, 3), (11, 5)):
        for _ in range(200):
            a = random.getrandbits(64)
            b = a
            for bit in random.sample(range(64), residue.HAMMING):
                b ^= 1 << bit
            assert set(residue.block_keys(a, blocks, choose)) & set(residue.block_keys(b, blocks, choose))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (50, 50)] + [(60, k) for k in range(61, 90)] + [(None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(frame(spark, edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[42] == 40 and all(got[k] == 60 for k in range(60, 90)) and 50 not in got


# 4. Personal information

FINDER = personal.Finder(frozenset({"Xanthe", "Vidar", "Merrin"}))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Write to Xanthe Hasksen at x.h+essays@mail.ulv.example or (555) 555-0131.", {"person_name", "email", "phone"}),
        ("x.h [at] ulv [dot] test", {"email"}),
        ("Submitted by Mr K. Nettby (passport no. A5098028).", {"person_name", "id_number"}),
        ("Questions go to a@b.test (01632 960179).", {"email", "phone"}),
        ("Return to: P.O. Box 11, Miremere 40643.", {"street_address"}),
        ("They live at Flat 18, 15 Raskano Row, Émermoor.", {"street_address"}),
        ("Wohnhaft in Corvriggstraße 51, 49565 Drayrigg, tel. +49 (0)30 23125-166.", {"street_address", "phone"}),
        ("St. Merrin Church and Mordinka Priory share one register.", set()),
        ("Form 123-73-1698; Item 229-1816; ISSN 6481-6481; Room 43, Varnmoor Hall.", set()),
        ("The @ sign was rare; the Ulv Street riots (Hollwell & Orr, 1999, pp. 184-190).", set()),
        ("The sample ran from 2003-07-17 to 2011-12-07; 10.5555/6134.51419", set()),
        ("", set()),
    ],
)
def test_personal(text, kinds):
    assert {i.kind for i in FINDER.items(text)} == kinds


def test_redaction_keeps_the_rest():
    assert FINDER.redact("Ask Vidar X. Roe (a@b.test), please.") == "Ask [PERSON_NAME] ([EMAIL]), please."


def test_disguised_characters_change_nothing(spark):
    rows = [(1, "Ring back on ＋４４ ２０ ７９４６ ０１４５ about it; gtullini@еxample.оrg"), (2, None), (3, ""), (1, "Ring back on ＋４４ ２０ ７９４６ ０１４５ about it; gtullini@еxample.оrg")]
    df = frame(spark, rows, "cit_id long, text string")
    counts = lookalikes.code_points([(df, "text")])
    got = {tuple(r) for r in personal.find(df, "cit_id", "text", frozenset(), counts).distinct().collect()}
    assert got == {(1, "email"), (1, "phone")}


# 5. Splitting


def greedy(lo, hi, size, overlap, marks):
    out, a = [], lo
    while a <= hi:
        c, kept = splitting.next_start(a, hi, size, overlap, sorted(set(marks)))
        out.append((a, min(c - 1, hi), kept))
        a = c - overlap if c <= hi else hi + 1
    return out


@pytest.mark.parametrize("width", [8, 64, 1024])
def test_splitting_equals_one_pass(spark, width):
    random.seed(width)
    items, marks, want = [], [], {}
    for k in range(40):
        lo = random.randint(1, 50)
        hi = lo + random.randint(0, 300)
        size = random.randint(1, 30)
        overlap = random.randint(0, size - 1)
        at = [random.randint(-5, 400) for _ in range(random.randint(0, 20))]
        items.append((k, k * 2, lo, hi, size, overlap))
        marks += [(k, a) for a in at] + [(k, None)]
        want[k, k * 2] = greedy(lo, hi, size, overlap, [a for a in at if lo < a <= hi])
    got = defaultdict(list)
    for r in splitting.split(frame(spark, items, "book_id long, chapter_no int, lo int, hi int, max_size int, overlap_size int"), frame(spark, marks, "book_id long, at int"), "book_id", ["book_id", "chapter_no"], width).collect():
        got[r["book_id"], r["chapter_no"]].append((r["piece"], r["lo"], r["hi"], r["at_boundary"]))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == want


def test_chapter_bounds(spark):
    schema = "chapter_id long, book_id long, chapter_no int, page_start int, page_end int, logical_pages int, limit_name string, parsed_at timestamp, title string, lo string"
    rows = [
        (1, 1, 1, 1, None, 90, "chapter_std", None, "", ""), (2, 1, 2, 50, None, 90, " Chapter_std", None, "", ""), (3, 2, 1, None, 9, 90, "chapter_std", None, "", ""), (4, 2, 2, 9, 3, 90, "chapter_std", None, "", ""),
        (5, 3, 1, 1, 5, 90, None, None, "", ""), (1, 1, 1, 1, None, 90, "chapter_std", None, "", ""),
    ]
    limits = frame(spark, [("chapter_std", "pages", 30, 2), ("batch", "tokens", 10, 0)], "limit_name string, size_unit string, max_size int, overlap_size int")
    got = splitting.chapter_bounds(frame(spark, rows, schema), limits)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 49, 30, 2), (1, 2, 50, 90, 30, 2)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    names, rows = oracle_rows(DATA, sql.oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(names, rows)


def test_files_are_split_by_byte_ranges(spark, tmp_path):
    random.seed(5)
    bodies = {}
    for k in range(3):
        text = "".join("".join(random.choices("abcé ", k=random.randint(1, 60))) + random.choice(["\n\n", "\n \n", "\n"]) for _ in range(120))
        bodies[k] = text.encode()
        (tmp_path / f"{k}.txt").write_bytes(bodies[k])
    (tmp_path / "empty.txt").write_bytes(b"")
    files = splitting.list_files(spark, str(tmp_path))
    for width in (256, 1 << 20):
        pieces = splitting.read_pieces(splitting.split_files(files, 200, 20, width=width)).collect()
        assert {int(os.path.basename(r["path"])[0]) for r in pieces} == {0, 1, 2}
        for k, raw in bodies.items():
            own = sorted((r for r in pieces if os.path.basename(r["path"]) == f"{k}.txt"), key=lambda r: r["piece"])
            ends = [m.end() for m in re.finditer(rb"\n\s*\n", raw)]
            assert [(r["lo"], r["hi"], r["at_boundary"]) for r in own] == greedy(0, len(raw) - 1, 200, 20, ends)
            assert all(bytes(r["body"]) == raw[r["lo"] : r["hi"] + 1] for r in own)


# 6. Look-alikes

IN_FORM = ["“Ж” marks it", "ΔT of 5 μm", "α, β and γ", "Β-diversity", "H₂O m² ½ № 5", "В уезде Корвгате память (Hollwell & Orr 12)", "共计8411例（1919年）", "a — b … ‘c’", "naïve Ångström", "line\r\nend", "", "☕️ ok"]
NOT_IN_FORM = {
    "Ｒｏｏｍ ５３": "Room 53", "été": "été", "a b c　d": "a b c d", "so­ft​": "soft", "coaﬆal oﬃce": "coastal office", "Тhe Мonastic Turn іn Hоltberg": "The Monastic Turn in Holtberg",
    "Οn Μercantile": "On Mercantile", "К 1800 году истоpия": "К 1800 году история", "(Fairley еt al., 2018, р. 71)": "(Fairley et al., 2018, p. 71)", "Έmergarth falls": "Émergarth falls", "a\tb": "a b",
}


def test_lookalikes():
    every = "".join([*IN_FORM, *NOT_IN_FORM, *NOT_IN_FORM.values()])
    c = lookalikes.Classes({ord(x): 1 for x in every})
    for t in IN_FORM:
        assert c.rewrite(t) == t, t
    for a, b in NOT_IN_FORM.items():
        assert c.rewrite(a) == b and c.rewrite(b) == b, a
    assert c.rewrite(None) is None


def test_classes_are_transitive():
    c = lookalikes.Classes({ord("Ａ"): 3})
    assert c._find("Ａ") == c._find("А") == c._find("Α") == c._find("A")


# 7. Tokens


@pytest.mark.skipif(not RANKS, reason="the rank file is not here")
def test_tokens_round_trip_and_parts():
    random.seed(3)
    texts = ["", " ", "don't stop", "a\n\n b\t\tc  ", "Ж漢字🙂 x", "x" * 5000, "".join(random.choice("ab \n.'s1é漢") for _ in range(4000))]
    for t in texts:
        ids = tokens.encode(t)
        assert tokens.decode_bytes(ids) == t.encode()
        assert tokens.encode(t, limit=7) == ids
        assert "".join(tokens.safe_parts(t, 5)) == t


@pytest.mark.skipif(not RANKS, reason="the rank file is not here")
def test_tokens_of_a_table(spark):
    df = frame(spark, [(1, None, 5), (2, "", 5), (3, "two words", 5), (3, "two words", 5)], "doc_id long, text string, ids int")
    assert sorted((r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df).collect()) == [(1, []), (2, []), (3, tokens.encode("two words")), (3, tokens.encode("two words"))]
    assert tokens.encode_corpus(df.where("false")).count() == 0


# 8. Packing


def test_fullest_is_the_best_sum():
    random.seed(4)
    for _ in range(60):
        sizes = [(random.randint(1, 30), random.randint(1, 3)) for _ in range(random.randint(1, 6))]
        sizes = list(dict(sizes).items())
        cap = random.randint(1, 80)
        sums = {0}
        for s, n in sizes:
            sums = {x + s * k for x in sums for k in range(n + 1) if x + s * k <= cap}
        used = packing.fullest(cap, sizes)
        assert sum(s * n for s, n in used.items()) == max(sums) and all(n <= dict(sizes)[s] for s, n in used.items())


def test_packing(spark):
    random.seed(5)
    rows = [(i, random.choice([7, 7, 7, random.randint(1, 250)])) for i in range(500)] + [(900, None), (901, 0), (902, 100), (903, 1000)]
    got = packing.pack(frame(spark, rows, "doc_id long, n_tokens int"), 100).collect()
    load, whole = defaultdict(int), defaultdict(list)
    for r in got:
        load[r["container"]] += r["size"]
        whole[r["doc_id"]].append((r["start"], r["end"]))
    assert max(load.values()) <= 100
    for i, n in rows:
        spans_ = sorted(whole[i])
        assert sum(b - a for a, b in spans_) == (n or 0)
        assert n is None or n > 100 or len(spans_) == (1 if n else 0)
    assert len(load) <= -(-sum(n or 0 for _, n in rows) // 100) + 2
    assert packing.pack(frame(spark, [], "doc_id long, n_tokens int"), 100).count() == 0


# 9. Shared spans


def brute(rows, length):
    grams = defaultdict(set)
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            grams[t[k : k + length]].add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def test_cover_has_every_difference():
    for q in (3, 5, 7, 11):
        d, period = spans.cover(q), q * q + q + 1
        assert {(int(a) - int(b)) % period for a in d for b in d} == set(range(period)) and len(d) == q + 1


def test_shared_spans(spark):
    random.seed(6)
    word = lambda n: "".join(random.choice("abcdé漢🙂 \r\n") for _ in range(n))
    passages = [word(n) for n in (199, 200, 201, 350)]
    rows = [(i, word(random.randint(0, 300)) + random.choice(passages) + word(random.randint(0, 300))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short"), (103, rows[0][1]), (104, passages[1]), (105, "x" * 900), (106, "y" + "x" * 500)]
    df = frame(spark, [(i, t, "z") for i, t in rows] + [(104, passages[1], "z")], "doc_id long, text string, id string")
    want = brute(rows, 200)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == want
    shares = {r["doc_id"]: r for r in spans.shared_share(df).collect()}
    assert set(shares) == {i for i, _ in rows}
    assert shares[103]["share"] == 1.0 and shares[104]["shared_chars"] == 200 and shares[101]["share"] == 0.0
    assert {i for i, r in shares.items() if r["shared_chars"]} == {x for p in want for x in p}
    assert spans.shared_pairs(df.where("false")).count() == 0
