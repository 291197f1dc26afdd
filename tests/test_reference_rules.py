"""Rules of retrieval, credibility, matrix, forensics, logs, routing and evaluation on small hand-made rows."""

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions.rounding import exact_round
from lumenfold.operators import credibility, forensics, index, logs, matrix, pages, retrieval, routing
from lumenfold.plans import search_queries
from lumenfold.sources import files


def _one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first().x


def test_tokens(spark):
    assert sorted(_one(spark, "中文词 2024年 Data7 x", T.tokens)) == sorted(["data", "中文", "中文词", "文词", "中", "文", "词", "年", "2024"])
    assert _one(spark, "HPLC2 a1", T.tokens) == ["hplc"] and sorted(_one(spark, "１２ 34", T.tokens)) == sorted(["１２", "34"])


def _greedy(text, size=500, overlap=100):
    out, cur = [], ""
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        long = len(line) > size
        if long and cur:
            out.append(cur)
            cur = ""
        parts = [p for p in re.split(r"(?<=[。；;！!？?])|(?<=\. )", line) if p.strip()] if long else [line]
        for p in parts:
            glue = "" if long or not cur else "\n"
            if len(cur) + len(p) + (0 if long else 1) <= size:
                cur += glue + p
            else:
                if cur:
                    out.append(cur)
                cur = p
    if cur:
        out.append(cur)
    led = [c if not i else out[i - 1][-overlap:] + "\n" + c for i, c in enumerate(out)]
    return [c for c in led if len(c.strip()) > 30]


def test_chunks(spark):
    rng = random.Random(1)
    texts = ["", " \n", "a" * 30, "a" * 31, "a" * 250 + "\n" + "b" * 249, "a" * 250 + "\n" + "b" * 250, "a" * 700]
    texts += ["".join(rng.choice(["word ", "Ends. ", "句。", "\n", "x" * 60, "! "]) for _ in range(rng.randrange(300))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id int, text string")
    got = {}
    for r in index.chunk_documents(df).collect():
        got.setdefault(r.doc_id, {})[r.chunk_no] = r.text
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got.get(i, {}).items())] == _greedy(t)
    assert [len(c) for c in _greedy(texts[5])] == [250, 351]


def test_credibility_rounding(spark):
    dims = spark.createDataFrame([("a", 0.7, 0.85, 0.7, 1.0, 0.87), ("b", 1.0, 1.0, 1.0, 1.0, 1.0), ("c", None, None, None, None, None)], "filename string, study double, venue double, method double, recency double, consensus double")
    assert {r.filename: (r.credibility, r.tier) for r in credibility.scored(dims).collect()} == {"a": (0.799, "B"), "b": (1.0, "A"), "c": (0.0, "C")}
    assert _one(spark, 0.7995, lambda c: exact_round(c, 3), "double") == 0.799


def test_sensitivity_of_all_draws(spark, tmp_path):
    """The registered query against the thousand draws of the reference, one by one."""
    rng, rows = random.Random(7), []
    for i in range(60):
        rows += [(f"f{i}", rng.choice(["原始实验", "综述", "其他"]), rng.choice(["Journal of Bark", "Blatt"]), rng.choice([None, 2000, 2010, 2018, 2024]), rng.random() < 0.6) for _ in range(3)]
    spark.createDataFrame(rows, "filename string, doc_kind string, journal string, citation_year int, in_vivo boolean").write.parquet(str(tmp_path / "extracted.parquet"))
    dims = [[x or 0.0 for x in r] for r in search_queries._dims(spark, str(tmp_path)).select(*credibility.DIMENSIONS).collect()]
    tiers = lambda w: ["A" if (x := round(sum(a * b for a, b in zip(d, w)), 3)) >= 0.8 else "B" if x >= 0.6 else "C" for d in dims]
    base, draws, rnd = tiers(credibility.WEIGHTS), [], random.Random(42)
    for _ in range(1000):
        w = [x + rnd.uniform(-0.05, 0.05) for x in credibility.WEIGHTS]
        draws.append(sum(a != b for a, b in zip(base, tiers([x / sum(w) for x in w]))))
    got = search_queries.sensitivity_random(spark, str(tmp_path)).first()
    assert abs(got.mean_changed - sum(draws) / 1000) < 1e-9 and got.most_changed == max(draws) and sum(draws[:100]) / 100 != sum(draws) / 1000
    none = credibility.changes(spark, search_queries._dims(spark, str(tmp_path)).limit(0), credibility.perturbed()).collect()
    assert len(none) == 10 and all(r.n_changed == 0 for r in none)


@pytest.mark.parametrize(("k", "pool", "want"), [
    (3, "C9 C8 C7 B6 A5", "C9 C8 A5"), (4, "C9 C8 C7 A6 B5 C4", "C9 C8 A6 B5"), (3, "C9 C8 C7 C4", "C9 C8 C7"), (3, "B9 B8 B7 A5*", "B9 B8 B7"), (2, "A9", "A9"),
])
def test_tier_quota(spark, k, pool, want):
    rows = [("q", i + 1, i, x[0], 0.0 if x.endswith("*") else 1.0, float(x[1])) for i, x in enumerate(pool.split())]
    df = spark.createDataFrame(rows, "query_id string, rank int, chunk_index int, tier string, bm25 double, score double")
    got = sorted(retrieval.tier_quota(df, k).collect(), key=lambda r: r.slot)
    assert " ".join(f"{r.tier}{r.score:.0f}" for r in got) == want


def test_context_budget(spark):
    sizes = [3000, 2500, 600, 100]
    rows = [("q", i + 1, f"f{i}", "t", "x" * (n - len(f"[{i + 1}] t\n\n"))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "query_id string, rank int, filename string, title string, text string")
    assert len(retrieval.contexts(df).first().context) == 5501
    assert len(retrieval.contexts(df, budget=10).first().context) == 0


def test_matrix(spark):
    rows = [("p1", matrix.EXPERIMENT, "X", "a1", 1), ("p1", matrix.EXPERIMENT, "X", "a1", 2), ("p1", matrix.EXPERIMENT, None, "a2", 3), ("p2", matrix.EXPERIMENT, None, "a1", 4), ("p2", matrix.EXPERIMENT, None, "a2", 5), ("p3", "review", "X", "a1", 6)]
    e = matrix.entries(spark.createDataFrame([(*r, None) for r in rows], "filename string, doc_kind string, compound string, action string, entry_id int, endpoint string"))
    lists = spark.createDataFrame([(p, x) for p in ("p1", "p2") for x in "XY"], "filename string, entity string")
    got = {(r.entity, r.action): (r.n, r.papers) for r in matrix.cells(matrix.pairs(e, lists)).collect()}
    assert got == {("X", "a1"): (3, "p1|p2"), ("X", "a2"): (1, "p2"), ("Y", "a1"): (1, "p2"), ("Y", "a2"): (1, "p2")}


@pytest.mark.parametrize(("ends", "want"), [
    (["IC50 = 2 μM", "IC50 = 9000 nM"], (4.5, 5.5)), (["IC50 = 2 μM", "IC50 = 5.9 μM"], None), (["IC50 = 2 μM", "10-40 μM"], None), (["2 mg/kg", "9 mg/kg"], None), (["IC50 = 2 μM", "IC50 = 9 µM"], None), ([None, ""], None),
])
def test_conflicts(spark, ends, want):
    e = spark.createDataFrame([("f", "X", "a", t) for t in ends], "filename string, entity string, action string, endpoint string")
    got = matrix.conflicts(matrix.values(e)).collect()
    assert [(r.fold, r.median_um) for r in got] == ([want] if want else [])


def _series(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "id string, pos int, value double")


def test_forensics(spark):
    r = forensics.last_digits(_series(spark, range(10, 101, 10))).first()
    assert (r.stat, r.zero_five, r.verdict) == (90.0, 1.0, "red")
    assert forensics.step_variance(_series(spark, range(10, 101, 10))).first().verdict == "red"
    assert forensics.last_digits(_series(spark, range(7))).count() == 0 and forensics.benford(_series(spark, range(1, 30))).count() == 0
    r = forensics.step_variance(_series(spark, [1, 2, 3, 4])).first()
    assert r.step_var_rel == 0 and r.verdict == "red"
    d = forensics.constant_difference(_series(spark, [5, 7, 9]), _series(spark, [3, 5, 7])).first()
    assert d.mean_diff == 2 and d.verdict == "red"
    assert {r.method for r in forensics.run_checks(_series(spark, range(40)), ("unknown", "runlength")).collect()} == {"runlength"}
    assert abs(forensics.chi2_sf_9(16.919) - 0.05) < 1e-4 and abs(forensics.chi2_sf_9(21.666) - 0.01) < 1e-4


def test_float_text(spark):
    for v in (1e-5, 1e7, 1.5e7, 1e16, 0.0001, 10.0, 123456789.25, 0.00012):
        assert _one(spark, v, forensics.float_text, "double").replace("E-", "e-0").replace("1.0e", "1e").rstrip() in (str(v), f"{v:.0f}.0", "1.0E16"), v


def test_shapiro():
    w, p = forensics.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.005 and 0.004 < p < 0.01
    assert forensics.shapiro([1.0] * 9) is None and forensics.shapiro([1, 2, 3, 4]) is None


def test_rate_limit(spark):
    df = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 10, 20, 61, 70, 71])] + [(None, 9, 1.0)], "account string, id int, t double")
    got = sorted(logs.rate_limit(df, limit=2).collect(), key=lambda r: r.id)
    assert [(r.allowed, r.retry_after) for r in got] == [(True, 0), (True, 0), (False, 41), (True, 0), (False, 1), (True, 0)]


def test_logs(spark):
    log = spark.createDataFrame([(1, None, "ABC", 0, "x"), (2, "", "b", 1, None), (3, "audit", None, 0, "x")], "id int, mode string, prompt string, think int, ip string").withColumn("day", F.lit("2024-01-03").cast("date"))
    assert {r.mode: r.n for r in logs.modes(log).collect()} == {"lecture": 2, "audit": 1}
    assert [tuple(r) for r in logs.hot_keywords(log, ["b", "zz"]).collect()] == [("b", 2)]
    assert logs.totals(log.limit(0), F.lit("2024-01-03").cast("date")).first().think_rate == 0
    assert [r.n for r in logs.daily(log, log.agg(F.max("day").alias("last"))).orderBy("day").collect()] == [0] * 6 + [3]


def test_evaluation(spark):
    v = spark.createDataFrame([("c1", "k1", True), ("c1", "k1", False), ("c1", "k2", True)], "cond string, cat string, pass boolean")
    assert {(r.cat, r.passed, r.n) for r in routing.pass_rates(v).collect()} == {("k1", 1, 2), ("k2", 1, 1), ("overall", 2, 3)}
    for t, ok in (("reason\nPASS", True), ("PASS\nFAIL", False), ("PASS or FAIL", False), ("", False), (None, None)):
        assert _one(spark, t, routing.passed) is ok


def test_routing(spark):
    assert _one(spark, "text\n>> a\n>> b\n", lambda c: routing.strip_followup(c, ">>")) == "text"
    assert _one(spark, "# H one # H two", lambda c: routing.cut_stream(c, "%%", "# H")) == "# H one "
    assert _one(spark, 'ok ["a", "\'b\'", "a", null, "' + "x" * 30 + '", "c?"] end', routing.parsed_followups) == ["a？", "b？", "c?"]
    assert _one(spark, "they think", lambda c: routing.has_any(c, ("hi",))) and not _one(spark, None, lambda c: routing.has_any(c, ("hi",)))


def test_pages(spark):
    text = "".join(f"Sentence number {i} stands here. " for i in range(60))
    df = spark.createDataFrame([(1, text[450:700], text, [0, 400, 800]), (2, text[350:500], text, [0, 400, 800]), (3, "not there at all, really", text, [0, 400])], "doc_id int, piece string, text string, offsets array<int>")
    assert {r.doc_id: r.page for r in pages.located(df, "piece", "text", "offsets").collect()} == {1: "2", 2: "1-2", 3: None}


def test_files(spark, tmp_path):
    ns = 'xmlns:w="http://w"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:d {ns}><w:p><w:t>Hello</w:t><w:t> there</w:t></w:p><w:p/><w:p><w:t>End</w:t></w:p></w:d>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", '<s xmlns="http://x"><row><c r="A1"><v>Title</v></c><c r="C1"><v>Year</v></c></row><row><c r="A2"><v>T1</v></c><c r="C2"><v>2020</v></c></row><row><c r="C3"><v>2021</v></c></row></s>')
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "c_ocr.txt").write_text("scanned", encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.filename: r for r in files.extracted(files.listed(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "Hello there\nEnd" and got["b.xlsx"].text == "title: T1" and got["c_ocr.txt"].text == "scanned"
    assert got["d.docx"].text is None and got["d.docx"].error and got["c.pdf"].error
    assert {r.filename for r in files.companions(files.extracted(files.listed(spark, str(tmp_path)))).where("text = 'scanned'").collect()} == {"c.pdf"}


def test_tables_notes_and_plain_pdf(tmp_path):
    import io
    import zlib

    def packed(parts):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return raw.getvalue()

    w = '<w:document xmlns:w="http://w"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p><w:r><w:t>first</w:t></w:r></w:p><w:p/></w:body></w:document>'
    assert files.docx(packed({"word/document.xml": w})) == "first\ncell"
    slide = lambda t: f'<p:sld xmlns:p="http://p" xmlns:a="http://a"><p:sp><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp></p:sld>'
    rels = '<Relationships><Relationship Type="http://x/notesSlide" Target="../notesSlides/notesSlide7.xml"/></Relationships>'
    notes = '<p:n xmlns:p="http://p" xmlns:a="http://a"><p:sp><p:ph type="sldNum"/><a:p><a:r><a:t>1</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>say this</a:t></a:r></a:p></p:sp></p:n>'
    got = files.pptx(packed({"ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide(" "), "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/notesSlide7.xml": notes}))
    assert got == "[slide 1]\none\n[notes] say this"
    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(there\\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET")
    raw = b"%PDF-1.4\n1 0 obj <</Type /Page /Contents 2 0 R>> endobj\n2 0 obj <</Filter /FlateDecode>> stream\n" + page + b"\nendstream endobj\n3 0 obj <</Type /Page>> endobj\n4 0 obj <</Title (A \\050b\\051) /Author <FEFF00C4>>> endobj\ntrailer <</Info 4 0 R>>"
    assert files.pdf_pages(raw) == ["Hello (there)\nWorld", ""] and files.pdf(raw) == "Hello (there)\nWorld"
    assert files.pdf_metadata(raw) == {"title": "A (b)", "author": "Ä"} and files.pdf_metadata(b"%PDF") == {"title": "", "author": ""}


def test_rule_files(tmp_path):
    (tmp_path / "r.yaml").write_text("design:\n  - id: D1\n    item: groups\n  - nothing\nother: text\n", encoding="utf-8")
    (tmp_path / "bad.yaml").write_text("a: [", encoding="utf-8")
    assert files.rule_file(str(tmp_path / "r.yaml"), {}) == {"design": [{"id": "D1", "item": "groups"}]}
    assert files.rule_file(str(tmp_path / "bad.yaml"), {"x": []}) == files.rule_file(str(tmp_path / "none.yaml"), {"x": []}) == {"x": []}


def test_report_sink(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "X", "降糖", 1), ("p2", "X", "降糖", 2), ("p2", "Y", "抗炎", 3)], "filename string, entity string, action string, pos int")
    lines = matrix.report(matrix.grid(matrix.pairs(rows.withColumn("raw_entity", F.col("entity")))))
    matrix.markdown(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert text[0].startswith("| entity |") and text[2].startswith("| X | 2 |") and len(text) == 4 + 10


def test_pages_by_hand_and_by_text(spark):
    pages = spark.createDataFrame([("f", 1, "alpha beta gamma delta epsilon"), ("f", 2, "zeta eta theta iota kappa lambda")], "filename string, page_no int, text string")
    chunks = spark.createDataFrame([(1, "f", "[summary] all"), (2, "f", "tail\nbeta gamma delta epsilon zeta eta"), (3, "f", "tail\neta theta iota kappa"), (4, "g", "x"), (5, "g", "y"), (6, "h", None)], "chunk_index int, filename string, text string")
    given = spark.createDataFrame([("g", ["7"])], "filename string, pages array<string>")
    got = {r.chunk_index: r.page for r in pages_of(chunks, pages, given)}
    assert got == {1: None, 2: "1-2", 3: "2", 4: "7", 5: None, 6: None}


def pages_of(*frames):
    return pages.assigned(*frames).collect()


def test_pages_of_long_files_and_repeated_pieces(spark):
    """A file's text is searched once for each piece, whatever the number of its pages, and rows with one number stay apart."""
    import time

    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(130)) for _ in range(500)]
    rows = [(i, "f", i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_index int, filename string, page_no int, text string")
    again = [(3, "f", "tail\n" + texts[8][50:500]), (3, "f", "tail\n" + texts[9][900:] + texts[10][:90]), (4, None, texts[4]), (5, "no file", texts[5])]
    chunks = df.select("chunk_index", "filename", F.concat(F.lit("tail\n"), "text").alias("text")).where("chunk_index > 9").unionByName(spark.createDataFrame(again, "chunk_index int, filename string, text string"))
    began = time.perf_counter()
    got = sorted((r.chunk_index, r.page or "") for r in pages_of(chunks, df.select("filename", "page_no", "text"), spark.createDataFrame([], "filename string, pages array<string>")))
    assert got == sorted([(i, str(i + 1)) for i in range(10, 500)] + [(3, "9"), (3, "10-11"), (4, ""), (5, "")])
    assert time.perf_counter() - began < 60
