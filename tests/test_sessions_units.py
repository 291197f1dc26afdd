import random
from decimal import Decimal

import numpy as np

from lumenfold.functions import quantities
from lumenfold.operators import sessions, units


def _brute(rows, gap):
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        end = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            e = max(s, e)
            if end is None or s > end + gap:
                out.append([k, s, e, 1])
                end = e
            else:
                end = max(end, e)
                out[-1][2], out[-1][3] = end, out[-1][3] + 1
    return sorted(map(tuple, out))


def test_sessions_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.5 else f"u{rng.randrange(5)}", s := rng.randrange(3000), s + rng.randrange(-5, 60)) for _ in range(700)]
    rows += [("tie", 0, 10), ("tie", 40, 50), ("tie", 81, 81), (None, 1, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, start_ms bigint, end_ms bigint, n_events string")
    for bucket in (7, 100, 10**6):
        got = sessions.sessionize(df, "k", gap_ms=30, bucket_ms=bucket).select("k", "start_ms", "end_ms", "n_events").collect()
        assert sorted(map(tuple, got)) == _brute(rows, 30)
    assert sessions.sessionize(df.limit(0), "k").count() == 0


def test_chat_events_spellings(spark):
    rows = [
        (1, "2024-01-08T06:30:05", " A-1", 5000.0), (1, "2024-01-08T06:30:05", " A-1", 5000.0), (2, "2024-01-08 06:30:05.500", "a-1", None),
        (3, "2024-01-08T06:30:05Z", "a-1 ", -4.0), (4, "2024-01-08T06:30:05+00:00", "  ", 1.0), (5, "no time", "b", 1.0), (6, None, "b", 1.0), (7, "2024-01-08T06:30:05", None, 1.0),
    ]
    got = sessions.chat_events(spark.createDataFrame(rows, "id bigint, ts string, user_id string, duration_ms double")).collect()
    base = 1704695405000
    assert sorted((r.user_id, r.id, r.start_ms - base, r.end_ms - base) for r in got) == [("a-1", 1, -5000, 0), ("a-1", 2, 500, 500), ("a-1", 3, 0, 0)]


def test_quantities():
    def common(t):
        return [(q, int(v.scaleb(p))) for _, q, v, p in quantities.read(t) if q]

    assert common("IC50 = 0.00632 mmol/L (0.0282 mg/mL)") == [("molar", 6320), ("mass_conc", 28200)]
    assert common("Ki（单位 μmol/l）：35.4；106.2；247.8") == [("molar", 35400), ("molar", 106200), ("molar", 247800)]
    assert common("pIC50 = 7.0") == [("molar", 100)]
    assert common("MBC = 0.737 ± 0.05 mg/mL") == [("mass_conc", 737000)]
    assert common("IC50 1.87×10² nM; 4.5×10⁻⁸ mol·L⁻¹") == [("molar", 187), ("molar", 45)]
    assert common("EC50 = 1,710ug/mL; 6,8 ng/mL") == [("mass_conc", 1710000), ("mass_conc", 6)]
    assert common("含量 = 0.0046 g/100 g") == [("content", 46)]
    assert common("含量（单位 mg/kg dry drug）：11700；35100") == [("content", 11700), ("content", 35100)]
    assert common("LD50 = 2.35 mg/kg body weight") == common("LD50 = 2.35 毫克/千克体重") == [("dose", 2350)]
    assert common("酪氨酸酶 IC50 ０．６０６ 微摩尔/升 to 1.2E-6 M") [0] == ("molar", 606)
    for t in (None, "", "  ", "IL-6 down by 96 % after 55 h", "n = 6, p < 0.05", "COX-2 in C57"):
        assert common(t) == []
    assert quantities.read("IC50 = 103") == [(7, None, Decimal(103), None)]


def test_changepoints_exact():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 12):
        x = np.round(rng.normal(size=n) + (np.arange(n) > n // 2) * 3, 2)

        def cost(starts):
            edges = [*starts, n]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:])) + 1.5 * len(starts)

        best = min((cost([0, *[i for i in range(1, n) if m >> i & 1]]) for m in range(0, 2 ** max(n, 1), 2)), default=0) if n else 0
        got = units.changepoints(x, 1.5)
        assert (not n and not got) or abs(cost(got) - best) < 1e-9


def test_units_operator(spark):
    rows = [(i, "f", "IC50 = 5 μM" if i < 6 else "IC50 = 5000 nM") for i in range(12)]
    rows += [(20, "f", "IC50 = 4900"), (21, "f", None), (22, None, "MIC = 0 μM"), (5000, "g", ""), (23, "f", "x" * 50000), (11, "f", "IC50 = 5000 nM"), (30, "h", "MIC 9999999999999999 g/L")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "entry_id bigint, filename string, endpoint string, common_value int")
    out = units.harmonised(df).collect()
    got = {(r.key, r.pos): r for r in out}
    assert len(out) == len(got) + 1  # a repeated row is repeated
    assert {r.common_value for k, r in got.items() if k[0] < 12} == {5000}
    assert got[6, 0].factor == 3 and got[5, 0].factor is None
    assert got[20, 0].decided == "history" and got[20, 0].common_value == 4900
    assert got[22, 0].common_value == 0
    assert got[30, 0].common_value is None  # beyond a bigint
    assert units.harmonised(df.limit(0)).count() == 0


def test_shift_gives_the_unit_of_a_segment_without_one(spark):
    rows = [(i, "f", f"IC50 = {5 + i % 2} mM") for i in range(8)] + [(10 + i, "f", f"IC50 = {5000 + 10 * i}") for i in range(8)]
    df = spark.createDataFrame(rows, "entry_id bigint, filename string, endpoint string")
    got = {r.key: r for r in units.harmonised(df).collect()}
    # The level rises by 10^3 without a unit: from mM the unit has changed to μM, which is reversed.
    assert [got[10 + i].common_value for i in range(8)] == [(5000 + 10 * i) * 1000 for i in range(8)]
    assert {got[10 + i].decided for i in range(8)} == {"history"} and got[3].decided == "segment"


def test_segments_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    values, level = [], 0.0
    for k in range(900):
        level = level if rng.random() > 0.04 else float(rng.integers(-4, 5))
        values.append(("hot" if k < 600 else f"s{k % 7}", k, 0, "molar", "IC50", round(level + rng.normal() * 0.1, 3), int(-level), 1))
    df = spark.createDataFrame(values, "source string, key bigint, pos int, quantity string, assay string, log_raw double, power int, common_value bigint")
    whole = sorted((r.source, r.key, r.segment) for r in units.unit_segments(df).collect())
    cut = sorted((r.source, r.key, r.segment) for r in units.unit_segments(df, block=64, halo=60).collect())
    assert whole == cut
