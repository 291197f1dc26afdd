import random
import re

from lumenfold.llm import splitting as S


def _texts():
    rng = random.Random(5)
    out = ["", " ", "a" * 5000, "x", "\r\n\r\n".join(["A b 3.5 c. D e! " * 20] * 9), "。".join("字" * rng.randrange(3, 80) for _ in range(400))]
    for _ in range(25):
        out.append("".join(rng.choice(["word ", "Satz. ", "句子。", "\n\n", "\n", "1.5 ", "y" * 40, "! ", "\r\n \r\n"]) for _ in range(rng.randrange(1, 900))))
    return out


def test_pieces_round_trip_and_limits(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([*texts, None])], "key int, text string, piece_no string")
    for size in (5000, 65536):
        got = {}
        for r in S.pieces(S.ranges(df, "key", "text", size=size)).collect():
            got.setdefault(int(r.id), []).append(r)
        for i, t in enumerate(texts):
            rows = sorted(got.get(i, []), key=lambda r: r.piece_no)
            assert [r.piece_no for r in rows] == list(range(len(rows))) and bool(rows) == bool(t)
            at = 0
            for k, r in enumerate(rows):
                assert len(r.text) <= 1000 and t[at:r.start_at].strip() == ""
                new = t[r.start_at:r.end_at]
                assert r.text.endswith(new)
                over = r.text[: len(r.text) - len(new)]
                assert not k or over == rows[k - 1].text[-100:]
                at = r.end_at
            assert t[at:].strip() == ""


def test_boundary_kinds_across_ranges(spark):
    texts = [t for t in _texts() if t.strip()]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    want = {}
    for i, t in enumerate(texts):
        eol = r"(?:\r\n|\r(?!\n)|\n)"
        ps = [p.strip() for p in re.split(rf"[^\S\r\n]*{eol}(?:[^\S\r\n]*{eol})+", t)]
        ss = [s.strip() for p in ps for s in re.split(r"(?<=[。！？；!?])(?![。！？；!?])|(?<=\.)(?=\s)", p)]
        want[str(i)] = (max(map(len, ps)), max(map(len, ss)))
    for size in (5000, 65536):
        got = {r.id: (r.paragraph, r.sentence) for r in S.longest_units(S.ranges(df, "key", "text", size=size)).collect()}
        assert got == want


def test_file_ranges(spark, tmp_path):
    t = "Ein Satz mit Ümlaut. 句子很短。\n\n" * 3000
    p = tmp_path / "big.txt"
    p.write_text(t, encoding="utf-8")
    rows = sorted(S.pieces(S.file_ranges(spark, [str(p)], size=20_000)).collect(), key=lambda r: r.piece_no)
    assert "".join(t[r.start_at:r.end_at] for r in rows) == t and all(r.text.endswith(t[r.start_at:r.end_at]) for r in rows)
    assert S.pieces(S.ranges(spark.createDataFrame([], "k int, t string"), "k", "t")).count() == 0
