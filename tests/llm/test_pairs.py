import random

from lumenfold.llm import pairs as P


def test_copied_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        r = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 20)))
        k = rng.randrange(1, 5)
        hit = [False] * len(r)
        for i in range(len(r)):
            for j in range(i + k, len(r) + 1):
                if r[i:j] in p:
                    hit[i:j] = [True] * (j - i)
        assert P.copied(p, r, k) == sum(hit)


def test_defects():
    q = "When should the bark be harvested?"
    for a in (None, "", " \n", "N/A", "（无）", "​", "...", "[no content]"):
        assert P.defect(q, a) == "empty"
    for a in (q, q.upper(), f"Question: {q}", f"“{q}”", f"{q}\n{q}", f"  {q[:-1]} "):
        assert P.defect(q, a) == "copy"
    assert P.defect(q, f"{q} In winter, after the leaves have fallen from the trees.") is None
    assert P.defect(q, "Thank you for asking. That is beyond my scope. Let us return to the course material.") == "refusal"
    assert P.defect(q, "I am not able to answer this question.", may_refuse=True) is None
    assert P.defect(q, "I cannot find a second source, so treat it with care.") is None
    assert P.defect("什么时候采收？", "抱歉，我无法回答这个问题。") == "refusal"
    assert P.defect(q, "落叶后采收的根皮纤维性强，易剥取。") == "other_language"
    assert P.defect(q + " Answer in Chinese.", "落叶后采收的根皮纤维性强，易剥取。") is None
    assert P.defect("什么时候采收？（英文作答）", "Harvest it after the leaf fall.") is None
    assert P.defect(q, "Die Rinde soll nach dem Laubfall geerntet werden.") == "other_language"
    for a in ("Harvest after leaf", "Dry it first, and", "There are three points:\n1. bark\n2. The", 'See ```json\n{"n": ', "Only with clean bl…", "Mind (the"):
        assert P.defect(q, a) == "truncated", a
    for a in ("In winter. [17]", "In winter. 🙂", "In winter.\n1. bark\n2. water 10.0 %", "| bark | none |", "In winter (see the table above)."):
        assert P.defect(q, a) is None, a
    assert P.defect(None, "In winter.") is None and P.defect(None, "In wint") == "truncated"


def test_frames(spark):
    rows = [("1", "a?", None), ("1", "a?", None), ("2", None, "x" * 40000 + "."), ("3", "b?", "Fine.")]
    df = spark.createDataFrame([("s", *r, None, 1) for r in rows], "src string, row_key string, prompt string, answer string, may_refuse boolean, defect int")
    assert sorted((r.row_key, r.defect) for r in P.defects(df).collect()) == [("1", "empty")] * 2
    assert P.defects(df.limit(0)).count() == 0
