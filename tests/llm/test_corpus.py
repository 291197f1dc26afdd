"""Small tests of the corpus operators: against brute force, and with nulls, blanks, long texts, ties, repeats, clashing names and empty tables."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import bilstm_crf as net
from lumenfold.llm import leaks, mixing, pii, scans, subjects, term_counts

LONG = "mulberry bark " * 8000


def test_term_counts(spark):
    texts = ["Bark of bark", "桑白皮 桑白", None, "", "  ", "x 12", "Bark of bark", LONG]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, term int")
    occ, rows = Counter(), Counter()
    for t in filter(None, texts):
        occ.update(term_counts.terms(t))
        rows.update(set(term_counts.terms(t)))
    got = term_counts.term_counts(df, id_range=2).collect()
    assert {r.term: (r.occurrences, r.n_rows) for r in got} == {t: (occ[t], rows[t]) for t in occ}
    assert sorted(r.term_id for r in got) == list(range(len(occ))) and [r.term for r in sorted(got, key=lambda r: r.term_id)] == sorted(occ, key=lambda t: t.encode())
    marks = {r.term: r.mark for r in term_counts.marked(term_counts.term_counts(df), df, rare=1, common=0.3).collect()}
    assert marks["of"] is None and marks["bark"] == "common" and marks["白皮"] == "rare"
    assert term_counts.term_counts(df.limit(0)).count() == 0


def test_tiles_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        p = [rng.choice("ab") for _ in range(rng.randrange(3, 18))]
        t = [rng.choice("abc") for _ in range(rng.randrange(3, 25))]
        seeds = [(i, j) for i in range(len(p) - 2) for j in range(len(t) - 2) if p[i:i + 3] == t[j:j + 3]]
        got = leaks.tiles(p, t, seeds, 3)
        best = max((n for i in range(len(p)) for j in range(len(t)) for n in range(3, 20) if i + n <= len(p) and j + n <= len(t) and p[i:i + n] == t[j:j + n]), default=0)
        assert (got[0][2] if got else 0) == best
        for k, (i, j, n) in enumerate(got):
            assert p[i:i + n] == t[j:j + n] and n >= 3
            assert all(i + n <= a or a + m <= i for a, _, m in got[:k]) and all(j + n <= b or b + m <= j for _, b, m in got[:k])


def test_leaks(spark):
    words = [f"w{i}" for i in range(30)]
    zh = "".join(chr(0x4E00 + 7 * i) for i in range(30))
    items = spark.createDataFrame([("i1", " ".join(words), zh, 1), ("i2", None, "", 2), ("i1", " ".join(words), zh, 1)], "id string, q string, rubric string, doc_id int")
    docs = [
        (1, "Intro. W0, w1 w2 – w3\nw4 w5 w6 ﻿w7 w8; w9 w10 w11 end"), (2, " ".join(words[:11])), (3, "，".join(zh[:20])), (4, zh[:19]), (5, None), (6, ""),
        (7, " ".join(words[20:29] + ["x"] + words[0:9])), (8, LONG + " ".join(words)), (1, "repeat w1"),
    ]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string")
    got = {(r.doc_id, r.field): r for r in leaks.leaks(df, items).collect()}
    assert {k for k, r in got.items() if r.verbatim} == {(1, "q"), (3, "rubric"), (8, "q")}
    assert got[7, "q"].tiles == 2 and got[7, "q"].coverage == 0.6 and not got[7, "q"].verbatim
    blocks = leaks.leaks(df, items, item_block=1).count()
    assert blocks == len(got) and leaks.leaks(df.limit(0), items).count() == 0 and leaks.leaks(df, items.limit(0)).count() == 0


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", " A", "b", "b-b", "B_B", None, "c"]), "wort " * rng.randrange(1, 40), 0.5) for i in range(400)]
    docs += [(900, "a", None, 0.1), (901, "a", "  ", 0.1), (None, "a", "x y", 0.1), (902, "b", "long " * 50, 0.0), (902, "b", "long " * 50, 0.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, target_share double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("b_b", 0.2, 4), ("none", 0.1, 5)], "source string, target_share double, max_repeat int")
    got = mixing.mix(df, targets).collect()
    assert sorted(r.position for r in got) == list(range(len(got))) and {r.source for r in got} == {"a", "b", "b_b"}
    place = [r.progress for r in sorted(got, key=lambda r: r.position)]
    assert place == sorted(place) and 0 <= place[0] and place[-1] <= 1
    used = Counter(r.doc_id for r in got)
    most = {"a": 1, "b": 3, "b_b": 4}
    assert all(used[r.doc_id] <= most[r.source] * (2 if r.doc_id == 902 else 1) for r in got) and 900 not in used
    shares = {r.source: r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    for s, p in (("a", 5 / 9), ("b", 2 / 9), ("b_b", 2 / 9), ("none", 0.0)):
        assert abs(shares[s].actual_share - p) < 0.02
    small = sum(r.n_tokens for r in mixing.mix(df, targets, total_tokens=1000).collect())
    assert abs(small - 1000) < 150
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_curriculum_inverse(spark):
    df = spark.createDataFrame([(s, x / 20) for s in (-0.5, -0.1, 0.0, 0.3, 1.0) for x in range(21)], "slope double, x double")
    y = F.col("x") + F.col("slope") * (F.col("x") * F.col("x") - F.col("x"))
    assert df.select(F.max(F.abs(mixing._invert(y, F.col("slope")) - F.col("x")))).first()[0] < 1e-9


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in net.init(15, 5, 4, 3, 1).items()}
    ids, tags, mask = rng.integers(0, 15, (6, 2)), rng.integers(0, 5, (6, 2)), np.ones((6, 2))
    mask[4:, 1] = 0
    _, g = net.loss_and_gradients(p, ids, mask, tags)
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        p[k][at] += 1e-3
        up = net.loss_and_gradients(p, ids, mask, tags)[0]
        p[k][at] -= 2e-3
        down = net.loss_and_gradients(p, ids, mask, tags)[0]
        p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-2


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    p = {"T": rng.normal(size=(3, 3)), "S": rng.normal(size=3)}
    e = rng.normal(size=(4, 1, 3))
    got = tuple(net.viterbi(p, e, np.ones((4, 1)))[:, 0])
    score = lambda y: p["S"][y[0]] + sum(e[t, 0, y[t]] for t in range(4)) + sum(p["T"][y[t], y[t + 1]] for t in range(3))
    assert got == max(itertools.product(range(3), repeat=4), key=score)


def test_personal_data(spark):
    rows = [
        (1, "My address for replies is dovan.kessary@lab.example. Thanks.", "手机129 5393 5176，随时可以联系。"), (2, None, ""), (3, "Tel: +1 206 555 0123.", "登记用的身份证号999383197505220276。"),
        (4, "凭证标本号为SB-2021-037。", "Batch 1920240417 was run at 254 nm and 280 nm with a flow of 1.0 mL/min."), (5, "样品请寄到霁川省青岑市南壑区望岫街357号8栋3单元。", LONG + " Call me on +1 206 555 0145 if it fails."), (1, "My address for replies is dovan.kessary@lab.example. Thanks.", "手机129 5393 5176，随时可以联系。"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, prompt string, answer string, kind string")
    got = {(r.id, r.field, r.kind) for r in pii.kinds(df, "id", ("prompt", "answer")).collect()}
    assert got == {(1, "prompt", "email"), (1, "answer", "phone"), (3, "prompt", "phone"), (3, "answer", "id_number"), (5, "prompt", "address"), (5, "answer", "phone")}
    clean = {r.id: r for r in pii.redacted(df, ("prompt", "answer")).collect()}
    assert clean[1].prompt == "My address for replies is [EMAIL]. Thanks." and clean[2].prompt is None and clean[2].answer == "" and clean[1].kind == "x"
    assert pii.redact("ab cd", [(0, 2, 4)]) == "[NAME] cd" and pii.kinds(df.limit(0), "id", ("prompt",)).count() == 0


def _pages():
    body = "the fresh bark was dried in the open store and the clear extract was kept cold until the assay of the marker compound began"
    rows = [(i, f"f{i % 7}", f"Title number {i}", body if i % 2 else body.replace(" the ", "\nthe "), None) for i in range(80)]
    rows += [
        (100, "g1", "On bark", "the fre5h bark was dri-\ned in the open store\n\n12\nThe Bark Letters 7\nand the clcar extract was well-\nknown until the assay", "11-12"), (101, "g2", "x", "The Bark Letters   13\nthe fresh bark was well-known and was well-known", None),
        (102, "g3", "y", "14  The Bark Letters 9\nthe fresh bark", None), (103, "g4", None, None, None), (104, None, None, "  ", None), (105, "g5", "z", LONG, "x"), (101, "g2", "x", "The Bark Letters   13\nthe fresh bark was well-known and was well-known", None),
    ]
    return rows


def test_scan_noise(spark):
    df = spark.createDataFrame([(*r, {"a": 1}) for r in _pages()], "chunk_index bigint, filename string, title string, text string, page string, line_no map<string,int>")
    got = {(r.chunk_index, r.line_no, r.noise) for r in scans.noise(df).collect()}
    assert {x for x in got if x[0] >= 100} == {(100, 0, "hyphen"), (100, 0, "misread"), (100, 3, "page_number"), (100, 4, "running_header"), (100, 5, "misread"), (101, 0, "running_header"), (102, 0, "running_header")}
    text = {r.chunk_index: r.text for r in scans.repaired(df).collect()}
    assert text[100] == "the fresh bark was dried in the open store and the clear extract was well-known until the assay" and text[103] is None and text[104] == "  "
    assert scans.noise(df.limit(0)).count() == 0


def test_misread_of_rare_words_in_large_tables(spark, monkeypatch):
    """A short word has a vector however small its share of all words is."""
    monkeypatch.setattr(scans, "RARE", 0.03)
    rows = [(i, "f", "x", t if i < 30 else t.replace("clear", "plain"), None) for i, (_, _, _, t, _) in enumerate(_pages()[:80])]
    rows += [(100, "g", "x", "the fresh bark was dried in the open store and the clcar extract was kept cold", None)]
    df = spark.createDataFrame(rows, "chunk_index bigint, filename string, title string, text string, page string")
    assert {(r.chunk_index, r.line_no, r.noise) for r in scans.noise(df).collect()} == {(100, 0, "misread")}


def test_skip_grams_are_learned_from_every_text(spark, monkeypatch):
    """A word that is just frequent enough has a vector, however many texts there are."""
    monkeypatch.setattr(scans, "FIT_ON", 100, raising=False)  # the number of texts above which a part was left out
    df = spark.createDataFrame([(i, ["bark", f"w{i % 30}", "root"]) for i in range(30 * scans.LEAST)], "chunk_index bigint, words array<string>")
    assert set(scans.skip_grams(df, scans.LEAST, 3 * df.count())) == {"bark", "root", *(f"w{i}" for i in range(30))}


def test_recurring_misreads_are_no_codes(spark):
    """Forms of letters and digits are known by what else the corpus writes, not by their number alone."""
    seen = {"mulberry": 900, "mu1berry": 24, "14": 700, "l4": 30, "sy5y": 235, "ptp1b": 180, "co5mo5": 25, "cosmos": 600, "l9": 40, "19": 90}
    words = spark.createDataFrame(list(seen.items()), "word string, n bigint")
    words = words.withColumn("n_joined", F.lit(0).cast("bigint"))
    assert {r.word for r in scans.known_codes(words, scans.links(words), 24_000_000).collect()} == {"sy5y", "ptp1b", "l9"}


def test_glyph_edits():
    assert {"mulberry", "rnuiberry"} & scans.glyph_edits("rnulberry") and "fruit" in scans.glyph_edits("friiit") and "again" in scans.glyph_edits("agam")


def test_tree_is_grown_on_all_clauses(spark, monkeypatch):
    """However many distinct clauses there are, each is a point of the tree, weighted by its number."""
    seen = []

    class Tree:
        def __init__(self, **given):
            pass

        def fit(self, points):
            seen.append(points.agg(F.count("*"), F.round(F.sum(F.col("n") * F.col("n")))).first())
            return self

        def clusterCenters(self):
            return [np.zeros(subjects.DIM)]

    monkeypatch.setattr(subjects, "BisectingKMeans", Tree)
    pairs = F.expr("flatten(transform(sequence(0, 999), j -> array(cast(id as int), cast(1000 + j as int))))")
    texts = spark.range(600).select(pairs.alias("keys"), F.array_repeat(F.lit(2), 1000).alias("clauses"))
    subjects.leaf_centres(texts.unionAll(texts), np.ones(subjects.BUCKETS, np.float32))
    assert [tuple(x) for x in seen] == [(600_000, 1_200_000)]


def test_subjects(spark):
    rng = random.Random(4)
    say = {"law": ["The court fined the seller of goods.", "A licence must show the date and origin.", "Inspectors signed the audit report."], "farm": ["Growers dug the roots after leaf fall.", "Rain brought blight to the young crop.", "The orchard gave a good harvest of fruit."]}
    rows, labels = [], []
    for i in range(240):
        a = "law" if i % 2 else "farm"
        rows.append((i, " ".join(rng.choice(say[a]) for _ in range(6)), "x"))
        if i % 5 == 0:
            labels.append((i, a))
    rows += [(900, " ".join(say["law"] + say["farm"]), "x"), (901, None, "x"), (902, " \n", "x"), (900, " ".join(say["law"] + say["farm"]), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    lab, areas = spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([("law",), ("farm",), (None,)], "subject string")
    got = subjects.subjects(df, lab, areas, leaves=12).select("doc_id", "subject").distinct().collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add(r.subject)
    assert found[900] == {"law", "farm"} and 901 not in found and 902 not in found
    assert sum(found.get(i) == {"law" if i % 2 else "farm"} for i in range(240)) > 230
    assert subjects.subjects(df.limit(0), lab, areas).count() == 0
