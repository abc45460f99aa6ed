"""Core training-data operators against brute force, and on odd inputs."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paddock.functions.unitparse import read_shape
from paddock.operators import hierarchy, intervals, rolling, units

TREES = {"sire": "sire_id", "dam": "dam_id"}


def horses(spark, rows):
    return spark.createDataFrame(rows, "horse_id int, sire_id int, dam_id int")


def climb(parent, a):
    seen, n = {a}, 0
    while a in parent:
        a, n = parent[a], n + 1
        if a in seen:
            return None
        seen.add(a)
    return a, n


@pytest.mark.parametrize("share", [200_000, 40])  # all links in one share, and many shares that tell each other
def test_hierarchy_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(hierarchy, "LINKS_A_TASK", share)
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, rnd.randint(1, i), rnd.randint(1, 420)]), rnd.choice([None, max(1, i - rnd.randint(1, 3))])) for i in range(1, 401)]
    ids = {r[0] for r in rows}
    links = hierarchy.valid_links(horses(spark, rows), "horse_id", TREES)
    forest = hierarchy.nested_sets(links, with_path=True).collect()
    want, pairs = set(), set()
    for tree, at in (("sire", 1), ("dam", 2)):
        parent = {r[0]: r[at] for r in rows if r[at] in ids}
        for a in parent:
            if end := climb(parent, a):
                want.add((tree, a, *end))
                b = a
                for k in range(1, end[1] + 1):
                    b = parent[b]
                    pairs.add((tree, b, a, k))
    assert {(r.tree, r.node, r.root, r.depth) for r in forest if r.depth} == want
    assert all(r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1 for r in forest)
    below = {tuple(r) for r in hierarchy.descendants(hierarchy.nested_sets(links)).collect()}
    assert below == pairs
    up = {}
    for r in rows:
        up.setdefault(r[0], set()).update(x for x in r[1:] if x in ids)

    def reach(a):
        seen, todo = set(), list(up.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        return seen

    over = {a: reach(a) for a in ids}
    loops = {(a, min(g), len(g)) for a in ids if a in over[a] for g in [{b for b in over[a] if a in over[b]}]}
    assert {tuple(r) for r in hierarchy.cyclic_groups(links).collect()} == loops and loops


def test_hierarchy_odd_rows(spark):
    rows = [(1, None, None), (1, 2, None), (2, None, None), (None, 1, 1), (3, 3, None), (4, 99, 3), (5, 6, None), (6, 5, None), (7, 5, None)]
    df = horses(spark, rows).withColumns({"node": F.lit("x"), "parent": F.lit(0), "tree": F.lit(1)})  # clashing names
    links = hierarchy.valid_links(df, "horse_id", TREES)
    assert {(r.tree, r.node, r.root, r.depth) for r in hierarchy.nested_sets(links).collect() if r.depth} == {("sire", 1, 2, 1), ("dam", 4, 3, 1)}
    assert {tuple(r) for r in hierarchy.cyclic_groups(links).collect()} == {(3, 3, 1), (5, 5, 2), (6, 5, 2)}
    none = hierarchy.valid_links(horses(spark, []), "horse_id", TREES)
    assert hierarchy.nested_sets(none).count() == 0 and hierarchy.cyclic_groups(none).count() == 0


def test_long_chain(spark):
    links = spark.range(1, 600).select(F.lit("t").alias("tree"), F.col("id").cast("int").alias("node"), (F.col("id") - 1).cast("int").alias("parent"))
    f = hierarchy.nested_sets(links)
    assert f.agg(F.max("depth"), F.min("root"), F.max("size")).first()[:] == (599, 0, 600)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 255), st.integers(0, 256))
def test_dyadic_nodes_tile_the_interval(a, b):
    """Each point of [a, b) lies in exactly one of the nodes the decomposition emits."""
    nodes = [(k, n) for k in range(9) for l, r in [(-(-a // (1 << k)), b >> k)] if l < r for n in ([l] if l & 1 else []) + ([r - 1] if r & 1 else [])]
    for p in range(256):
        assert sum((p >> k) == n for k, n in nodes) == (a <= p < b)


def test_stab_equals_brute_force(spark):
    rnd = random.Random(3)
    iv = [(rnd.randint(0, 2), i, *(sorted((rnd.randint(-5, 90), rnd.randint(-5, 90))))) for i in range(80)] + [(0, 900, None, 10), (1, 901, 50, None), (2, 902, None, None), (0, 903, 5, 5)]
    pt = [(rnd.randint(0, 3), j, rnd.randint(0, 80)) for j in range(120)] + [(0, 500, None), (None, 501, 4)]
    got = intervals.stab(spark.createDataFrame(pt, "k int, j int, p int"), spark.createDataFrame(iv, "k int, i int, a int, b int"), ["k"], "p", "a", "b")
    want = {(j, i) for k, j, p in pt for k2, i, a, b in iv if k is not None and p is not None and k == k2 and (a is None or a <= p) and (b is None or p < b)}
    rows = [(r.j, r.i) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert intervals.stab(spark.createDataFrame([], "k int, j int, p int"), spark.createDataFrame(iv, "k int, i int, a int, b int"), ["k"], "p", "a", "b").count() == 0


def test_as_known_learns_nothing_later(spark):
    v = spark.createDataFrame([(1, 0, None, 0, 5, "old"), (1, 0, None, 5, None, "new"), (1, 3, 8, 1, None, "short"), (None, 0, None, 0, None, "lost")], "k int, a int, b int, x int, y int, who string")
    e = spark.createDataFrame([(1, d) for d in range(10)] + [(1, 2), (2, 2), (None, 3), (1, None)], "k int, day int")
    got = {(r.k, r.day): r.who for r in intervals.as_known(e, v, ["k"], "day", "a", "b", "x", "y", ["a", "x"], ["who"]).collect()}
    assert got == {(1, d): "short" if 3 <= d < 8 else "old" if d < 5 else "new" for d in range(10)}
    earlier = v.where("x < 5")
    before = {(r.k, r.day): r.who for r in intervals.as_known(e.where("day < 5"), earlier, ["k"], "day", "a", "b", "x", "y", ["a", "x"], ["who"]).collect()}
    assert before == {k: w for k, w in got.items() if k[1] < 5}


def test_trailing_equals_brute_force(spark):
    rnd = random.Random(5)
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(n)
    daily = [(t, day(n), rnd.randint(1, 9)) for t in (1, 2) for n in sorted(rnd.sample(range(400), 60))] + [(None, day(3), 1), (1, None, 4)]
    df = spark.createDataFrame(daily, "t int, d date, n int")
    days = rolling.calendar(df, "t", "d")
    got = {(r.t, r.d): (r.n_7, r.n_30, r.n_90) for r in rolling.trailing(days, df, "t", "d", ["n"], [7, 30, 90]).collect()}
    first = {t: min(d for u, d, _ in daily if u == t and d) for t in (1, 2)}
    last = max(d for _, d, _ in daily if d)
    want = {}
    for t in (1, 2):
        d = first[t]
        while d <= last:
            want[t, d] = tuple(sum(n for u, x, n in daily if u == t and x and 1 <= (d - x).days <= p) or None for p in (7, 30, 90))
            d += dt.timedelta(1)
    assert got == want
    assert rolling.trailing(days.limit(0), df.limit(0), "t", "d", ["n"], [7]).count() == 0


@pytest.mark.parametrize(
    ("text", "field", "want"),
    [
        ("99.999 kr", "money", ("plain", "kr", 0)), ("999 tusen kr", "money", ("plain", "kr", 3)), ("99 tkr", "money", ("plain", "kr", 3)), ("9 999 999 öre", "money", ("plain", "kr", -2)), ("99999 EUR e-2", "money", ("plain", "EUR", -2)),
        ("US$ 999", "money", ("plain", "USD", 0)), ("$9,999", "money", ("plain", "USD", 0)), ("NOK 9 999", "money", ("plain", "NOK", 0)), ("999999 DKK øre", "money", ("plain", "DKK", -2)), ("-", "money", None), ("kr", "money", None), ("9999", "money", None),
        ("9 kr 9 €", "money", None), ("99,9a", "time", ("short", "", 0)), ("9:99.9 mi", "time", ("clock", "", 0)), ("dg", "time", None), ("", "time", None), ("9999", "time", None),
    ],
)
def test_shapes(text, field, want):
    r = read_shape(text, field)
    assert (r and (r.form, r.currency, r.exponent)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="9 .,:'\"/()abcegikmnortsuöø€$-", max_size=40), st.sampled_from(["money", "time"]))
def test_any_shape_is_read_or_refused(text, field):
    r = read_shape(text, field)
    assert r is None or r.groups > 0


ENTRY = "entry_id bigint, race_date date, distance int, prize_kr bigint, prize_currency string, prize_original decimal(14,2), prize_fx_rate decimal(12,6), time_seconds double, time_text string, source_data string, last_updated_at timestamp_ntz"


def test_restated(spark):
    d, t = dt.date(2024, 3, 10), dt.datetime(2024, 3, 10, 12)
    row = lambda i, **k: (i, k.get("d", d), k.get("dist", 2140), k.get("kr"), k.get("ccy"), k.get("orig"), k.get("fx"), k.get("s"), k.get("txt"), k.get("sd"), k.get("t", t))
    rows = [
        row(1, kr=0, ccy="SEK", sd='{"st": {"prize_txt": "27.500 kr"}}'), row(2, kr=27500, ccy="SEK", sd='{"st": {"prize_txt": "27 500 kr"}}'), row(3, kr=100, ccy="SEK", sd='{"letrot": {"gain": "100 €"}}'),
        row(4, kr=100, ccy="EUR"), row(5, kr=2750000, ccy=None, sd='{"atg": {"prize": {"amount": 2750000, "unit": "öre"}}}'), row(6, kr=12, ccy="SEK", sd='{"st": {"prize_txt": "12 tkr"}}'), row(7, kr=0, ccy="SEK", sd='{"st": {"note": "ok"}}'),
        row(8, s=1136.0), row(9, s=73600.0), row(10, s=9.0e15), row(11, s=None, txt="13,6a"), row(12, s=73.6, txt="1'13\"6"), row(13, s=157.5, txt="2.37,5 tot"), row(14, s=119.0, txt="1:59.0 mi"), row(15, s=0.0, txt="dg"),
        row(16, kr=5, sd='{"st": {"prize_'), row(17, kr=100, ccy="EUR", d=dt.date(2020, 1, 1)), row(18, kr=7, t=dt.datetime(2024, 3, 9), sd='{"st": {"prize_txt": "9 kr"}}'), row(18, kr=9, sd='{"st": {"prize_txt": "9 kr"}}'), row(None, s=1136.0), row(20),
    ]
    from decimal import Decimal

    fx = spark.createDataFrame([("EUR", dt.date(2024, 3, 8), Decimal("11.25")), ("EUR", dt.date(2024, 3, 11), Decimal("99")), (None, d, Decimal(1))], "ccy string, rate_date date, sek_per_unit decimal(12,6)")
    e = spark.createDataFrame(rows, ENTRY).withColumns({"text": F.lit("x"), "field": F.lit(1), "ccy": F.lit("y")})  # clashing names
    got = {(r.entry_id, r.field_name): r.amount for r in units.restated(e, fx).collect()}
    P, T = "prize_kr", "time_seconds"
    assert got == {(1, P): 27500, (3, P): 1125, (4, P): 1125, (5, P): 27500, (6, P): 12000, (8, T): 736, (9, T): 736, (11, T): 736, (13, T): 736, (14, T): 739}
    assert units.restated(e.limit(0), fx).count() == 0 and units.restated(e, fx.limit(0)).where("field_name = 'prize_kr'").count() == 3


def test_all_descendants_over_both_links_and_below_cycles(spark):
    rows = [(1, None, None), (2, 1, None), (3, None, 2), (4, 3, 1), (5, 6, None), (6, 5, None), (7, 6, 3), (8, None, 7), (9, 9, None), (10, 99, 9)]
    up = {r[0]: {x for x in r[1:] if x and x != 99} for r in rows}
    want, new = set(), {(p, c) for c, ps in up.items() for p in ps}
    while new:
        want |= new
        new = {(p, c) for a, c in want for p in up[a]} - want
    links = hierarchy.valid_links(horses(spark, rows), "horse_id", TREES)
    got = [tuple(r) for r in hierarchy.all_descendants(links).collect()]
    assert set(got) == want and len(got) == len(want) and (1, 3) in want and (5, 8) in want
    rnd = random.Random(3)
    many = [(i, rnd.choice([None, rnd.randint(1, i), rnd.randint(1, 66)]), rnd.choice([None, max(1, i - rnd.randint(2, 9))])) for i in range(1, 61)]
    ids = {r[0] for r in many}
    up = {r[0]: {x for x in r[1:] if x in ids} for r in many}
    want, new = set(), {(p, c) for c, ps in up.items() for p in ps}
    while new:
        want |= new
        new = {(p, c) for a, c in want for p in up[a]} - want
    got = [tuple(r) for r in hierarchy.all_descendants(hierarchy.valid_links(horses(spark, many), "horse_id", TREES)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert hierarchy.all_descendants(links.limit(0)).count() == 0
