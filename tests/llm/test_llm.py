"""Corpus operators against brute force, by properties and on odd inputs."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paddock.llm import components, linkage, mixing, packing, queries, reading, survivor, tokens
from paddock.llm import sql as corpus_sql


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, small, name):
    import oracle

    df = queries.queries()[name](spark, small)
    if name in corpus_sql.SQL:
        assert oracle.differences(df, oracle.connect(small), corpus_sql.SQL[name]) == ""
    else:
        assert df.count() > 0


def brute(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {(find(x), x) for x in top}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "odd", "empty"])
def test_components(spark, kind):
    rnd = random.Random(1)
    pairs = {
        "random": [(rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(170)], "chain": [(i, i + 1) for i in range(0, 120)] + [(500 + i, 501 + i) for i in range(40)],
        "star": [(0, i) for i in range(1, 80)] + [(i, 1000 + i) for i in range(1, 40)], "odd": [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5)], "empty": [],
    }[kind]
    df = spark.createDataFrame(pairs, "x int, y int").withColumns({"a": F.lit(1), "u": F.lit(2)})
    rows = [tuple(r) for r in components.components(df, "x", "y").collect()]
    assert set(rows) == brute(pairs) and len(rows) == len(set(rows))


HORSE = "horse_id int, name string, date_of_birth date, gender_code string, birth_country string, sire_name string, dam_name string, source_data string, primary_source string, last_updated_at timestamp_ntz, sire_id int"


def test_survivors(spark):
    d, t = dt.date(2010, 5, 1), dt.datetime(2024, 1, 1)
    rows = [
        (1, "Okänd", dt.date(1910, 11, 12), "?", "SE", None, "-", None, "usta", t, 0), (2, "Foo", d, "H", "XX", "Bar", None, '{"st": {"x": 1', None, t, 0), (3, "Foo*", None, "V", None, "Baz", "", None, "Trav-Sport", dt.datetime(2025, 3, 1), 0),
        (4, "Alone", d, "H", "SE", None, None, None, "st", t, 0), (5, None, None, None, None, None, None, None, None, None, None),
    ]
    h, g = spark.createDataFrame(rows, HORSE).withColumn("value", F.lit(1)), spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (1, 5)], "group_id int, id int")
    got = {(r.field_name): r.row_id for r in survivor.survivors(survivor.claims(h, g)).collect()}
    assert got == {"name": 2, "date_of_birth": 2, "gender_code": 2, "birth_country": 1, "sire_name": 2}
    assert survivor.survivors(survivor.claims(h.limit(0), g)).count() == 0


def test_judge_finds_the_bad_source(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        for s, good in (("a", 0.95), ("b", 0.9), ("d", 0.85), ("c", 0.3)):
            rows.append((i, i * 10 + ord(s), s, "t" if rnd.random() < good else f"f{rnd.randint(0, 5)}"))
    said = spark.createDataFrame(rows, "group_id int, row_id int, source string, value string").withColumns({"field_name": F.lit("name"), "key": F.col("value"), "seen": F.lit(None).cast("timestamp_ntz")})
    beliefs, quality = survivor.judge(said)
    assert quality["name", "a"][0] > quality["name", "c"][0] and quality["name", "c"][1] < quality["name", "a"][1]
    won = survivor.survivors(said, trust=None, known=(beliefs, quality))
    assert won.where("value = 't'").count() >= 285
    kept = survivor.kept_values(said, (beliefs, quality))
    assert kept.where("value = 't'").count() >= 280


RAW = "raw_id bigint, source string, name string, date_of_birth string, sex_text string, country_text string, sire_name string, dam_name string"


def test_linkage(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ka", "lu", "mi", "ro", "te", "sö", "vå"]) for _ in range(4)).capitalize()
    home, raw, truth = [], [], set()
    for i in range(250):
        name, sire, dam, born = word() + " " + word(), word(), word(), dt.date(2000 + i % 20, 1 + i % 12, 2 + i % 27)
        home.append((i, name, born, "SHV"[i % 3], "SE", sire, dam, None, "st", None, None))
        if i % 2:
            k = rnd.randint(1, len(name) - 2)
            typo = [name, name.upper(), name[:k] + name[k + 1 :], name.replace("ö", "oe") + "* (SE)"][i % 4]
            raw.append((1000 + i, "hvt", typo, born.strftime("%d.%m.%Y") if i % 5 else None, ["Stute", "Hengst", "Wallach"][i % 3], "Sverige", sire if i % 7 else None, dam))
            truth.add((i, 1000 + i))
        else:  # a sibling, which is another animal
            raw.append((1000 + i, "hvt", word(), born.replace(year=born.year + 1).strftime("%d.%m.%Y"), "Stute", "SE", sire, dam))
    raw += [(5000, None, None, "", None, None, None, "?"), (5001, "usta", "Unknown", "11/12/1910", None, None, None, None)]
    h, r = linkage.horse_traits(spark.createDataFrame(home, HORSE)), linkage.raw_traits(spark.createDataFrame(raw, RAW))
    got = {(x.id, x.other_id) for x in linkage.matches(h, r).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.1 * len(truth)
    assert linkage.matches(h, r.limit(0)).count() == 0


def test_linkage_splits_large_blocks(spark, monkeypatch):
    rows = [(i, "Same Name", dt.date(2000 + i % 20, 3, 4), "S", "SE", f"Sire{chr(65 + i % 26)}x", f"Dam{chr(65 + i % 26)}{chr(65 + i // 26)}", None, "st", None, None) for i in range(60)]
    raw = [(100 + i, "hvt", "Same Name", f"04.03.{2000 + i % 20}", "Stute", "SE", f"Sire{chr(65 + i % 26)}x", f"Dam{chr(65 + i % 26)}{chr(65 + i // 26)}") for i in range(60)]
    h, r = linkage.horse_traits(spark.createDataFrame(rows, HORSE)), linkage.raw_traits(spark.createDataFrame(raw, RAW))
    (a, _), (b, _) = linkage.profiles(h), linkage.profiles(r)
    whole = set(linkage.candidates(a, b).collect())
    monkeypatch.setattr(linkage, "BLOCK_PAIRS", 10)
    split = set(linkage.candidates(a, b).collect())
    assert split <= whole and len(split) < len(whole)
    day = {(r.pid, r.day, r.sire) for r in a.collect()}, {(r.pid, r.day, r.sire) for r in b.collect()}
    alike = {(x, y) for x, d, s in day[0] for y, e, t in day[1] if d == e or s == t}
    assert alike <= {(p.l, p.r) for p in split}  # every pair that agrees on more than the common name


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plan(counts):
    slots, n = packing.plan(counts, 64)
    fill = [0] * n
    seen = {k: set() for k in counts}
    for s in slots:
        assert (s.stop - s.start) % s.each == 0
        for rank in range(s.start, s.stop):
            assert rank not in seen[s.length]
            seen[s.length].add(rank)
            fill[s.first + (rank - s.start) // s.each] += s.length
    assert all(seen[k] == set(range(c)) for k, c in counts.items()) and all(0 < x <= 64 for x in fill)
    room = []  # plain best fit decreasing, one item at a time
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            fits = [x for x in room if x >= k]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else 64) - k)
    assert sorted(64 - x for x in room) == sorted(fill)


def test_packing(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 25), (4, 0), (5, 10), (None, 3), (7, None), (1, 5)], "doc_id bigint, tokens bigint").withColumn("length", F.lit(1))
    specs = spark.createDataFrame([("s", 10), (None, 3), ("bad", 0), ("s", 10)], "spec_name string, capacity_tokens int")
    out = packing.packed(sizes, specs).collect()
    assert len(out) == 10 and sum(r.tokens for r in out) == 53
    fill = {}
    for r in out:
        assert (r.container_id is None) == (r.tokens == 0)
        if r.tokens:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    assert max(fill.values()) <= 10 and len(fill) == 6
    assert packing.packed(sizes.limit(0), specs).count() == 0 and packing.packed(sizes, specs.limit(0)).count() == 0


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, s, f"t{i}", rnd.randint(10, 900)) for i, s in enumerate(rnd.choices(["A src", "a-SRC", "b", "c", None], [5, 1, 3, 2, 1], k=3000))]
    rows += [(9001, "b", "t9001", 50), (9002, "a_src", "t9001", 50), (9003, "b", None, 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, text_id string, tokens bigint")
    targets = spark.createDataFrame([("a_src", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(sizes, targets)
    got = {r.source: r for r in mixing.reached(mix, sizes, targets).collect()}
    for s, share in (("a_src", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95), ("absent", 0)):
        assert abs(got[s].actual_share - share) < 0.005
    assert got["a_src"].most_uses <= 1 and got["b"].most_uses <= 2 and got["c"].most_uses <= 4
    assert {r.doc_id for r in mix.where("doc_id > 9000").collect()} <= {9001}
    assert mixing.mixed(sizes.limit(0), targets).count() == 0


def test_pareto_inclusion_follows_size():
    take = mixing.draw_numbers([(1, 1000, 10_000), (2, 100, 10_000)], 5_000)
    assert abs(sum(n * (10 if k == 1 else 100) for k, (n, _) in take.items()) - 5_000) <= 10
    assert take[2][0] / 100 > take[1][0] / 1000


def test_tokens(spark):
    rows = [(1, "a", "Hästen drog hårt! <|endoftext|>"), (2, "a", ""), (3, None, None), (None, "b", "x" * 20_000), (5, "b", "Hästen drog hårt! <|endoftext|>")]
    got = tokens.counted(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()
    by = {r.doc_id: r for r in got}
    enc = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    assert by[1].tokens == len(enc.encode_ordinary(rows[0][2])) and enc.decode(enc.encode_ordinary(rows[0][2])) == rows[0][2]
    assert by[2].tokens == by[3].tokens == 0 and by[2].text_id is by[3].text_id is None
    assert by[1].text_id == by[5].text_id and by[None].tokens > 0


EASY, HARD = "The horse ran fast. The mare was calm. A colt won.", "Notwithstanding the provisional character of the available measurements, the regulatory interpretation substantiated an otherwise speculative methodological assessment of cumulative resilience, because the committee deliberated."


def test_reading(spark):
    docs = [(i, (EASY if i % 2 else HARD) + " " + (EASY if i % 2 else HARD)) for i in range(60)] + [(100, None), (101, ""), (102, "1. Foo 12,3 7/2140 63 000 kr\n2 | Bar | 13,4 |"), (103, EASY), (103, EASY), (104, "<p>" + HARD + "</p>")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"level": F.lit(9), "score": F.lit(1)})
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 5) for i in range(30)] + [(102, "r", None)], "doc_id bigint, rater string, reading_level int")
    got = reading.reading_levels(df, labels).collect()
    level = {r.doc_id: r.reading_level for r in got}
    assert {100, 101, 102}.isdisjoint(level) and len(got) == 63
    assert all(level[i] <= 2 if i % 2 else level[i] >= 4 for i in range(30, 60)) and level[103] <= 2 and level[104] >= 4
    assert {r.reading_level for r in reading.reading_levels(df, labels.limit(0)).collect()} == {3}
    assert reading.reading_levels(df.limit(0), labels).count() == 0


def test_levels_on_held_out_judgements(spark, small):
    d = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/reading_label.parquet")
    out = reading.reading_levels(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    held = labels.where("pmod(xxhash64(doc_id), 2) = 1 and reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("m"), F.count_distinct("reading_level").alias("k")).where("k = 1")
    rows = held.join(out, "doc_id").collect()
    assert np.mean([r.m == r.reading_level for r in rows]) > 0.9


def test_repaired_text():
    assert reading.repaired("Der Pfleger kam zurÃ¼ck. Dotierung 46.000 â‚¬") == "Der Pfleger kam zurück. Dotierung 46.000 €"
    assert reading.repaired("Ã ok\nfine é") == "Ã ok\nfine é"


def test_linkage_large_blocks_lose_no_pair(spark, monkeypatch):
    rnd = random.Random(9)
    rows, raw = [], []
    for i in range(60):
        born, sire, dam = dt.date(2000 + i % 5, 1 + i % 12, 2 + i % 20), rnd.choice(["Karlo", "Mirabell", "Tesoro"]) + chr(97 + i % 9), rnd.choice(["Lumina", "Rosetta"]) + chr(97 + i % 7)
        rows.append((i, "Same Name", born, "S", "SE", sire, dam, None, "st", None, None))
        said = [(born + dt.timedelta(1)).strftime("%d.%m.%Y"), str(born.year), born.strftime("%d.%m.%Y"), None][i % 4]  # a day off, the year only, right, missing
        raw.append((100 + i, "hvt", "Same Name", said, "Stute", "SE", [sire[:-1], sire[:-3], sire][i % 3], [dam[:2] + dam[3:], None, dam][i % 3]))
    rows += [(200 + i, f"Other{chr(97 + i)}name", dt.date(1990 + i, 5, 6), "H", "SE", "Tesoro", "Rosetta", None, "st", None, None) for i in range(9)]
    raw += [(300 + i, "hvt", f"Other{chr(97 + i)}nam", f"07.05.{1990 + i}", "Hengst", "SE", "Tesoro", "Rosetta") for i in range(9)]
    h, r = linkage.horse_traits(spark.createDataFrame(rows, HORSE)), linkage.raw_traits(spark.createDataFrame(raw, RAW))
    (a, _), (b, _) = linkage.profiles(h), linkage.profiles(r)
    seen = lambda: sorted(tuple(x) for x in linkage.scored(a, b).select("l", "r", F.round("p", 6)).collect())
    whole = seen()
    for name, value in (("BLOCK_PAIRS", 10), ("SALT_PAIRS", 50), ("MOST_SALTS", 4)):
        monkeypatch.setattr(linkage, name, value, raising=False)
    assert seen() == whole and len({x[:2] for x in whole}) == len(whole)


def test_linkage_pair_with_only_a_common_name(spark, monkeypatch):
    """It stays apart while the model could not take it for a match, and is put together as soon as it could."""
    rows = [(i, "Same Name", dt.date(1960 + i % 50, 1 + i % 12, 2 + i % 20), "S", "SE", f"{chr(65 + i % 26)}ire{chr(97 + i % 26)}", f"{chr(65 + i % 25)}am{chr(97 + i % 25)}", None, "st", None, None) for i in range(50)]
    rows.append((999, "Same Name", None, None, None, None, None, None, "st", None, None))
    raw = [(100 + i, "hvt", "Same Name", f"0{1 + i % 9}.0{1 + i % 9}.{1900 + i}", "Stute", "SE", f"Zz{chr(97 + i)}qx", f"Ww{chr(97 + i)}vk") for i in range(20)] + [(888, "hvt", "Same Name", None, None, None, None, None)]
    (a, ai), (b, bi) = linkage.profiles(linkage.horse_traits(spark.createDataFrame(rows, HORSE))), linkage.profiles(linkage.raw_traits(spark.createDataFrame(raw, RAW)))
    monkeypatch.setattr(linkage, "BLOCK_PAIRS", 10)
    monkeypatch.setattr(linkage, "COMMON_PAIRS", 10)
    ids = lambda pairs: {(x.h, x.r) for x in pairs.join(ai.select(F.col("pid").alias("l"), F.col("id").alias("h")), "l").join(bi.select(F.col("pid").alias("r"), F.col("id").alias("r2")), "r").select("h", F.col("r2").alias("r")).collect()}
    assert (999, 888) in ids(linkage.scored(a, b, 0.0))
    assert len(ids(linkage.scored(a, b, 0.0))) == len(rows) * len(raw)
    assert len(ids(linkage.scored(a, b, 0.9))) < len(rows) * len(raw) / 4
    every = linkage._accepted(linkage.Model(np.full(5, 0.2), [np.log(np.full((n - 1, 5), 1 / (n - 1))) for n in linkage.LEVELS.values()]), ["n"], 0.0)
    assert every == {("n", k) for k in range(32)}


def test_levels_by_joined_dictionary(spark, small, monkeypatch):
    """The dictionary of words sent to all executors and the joined one give the same levels; so do no rounds at all, by form alone."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet").dropDuplicates(["doc_id"]), spark.read.parquet(f"{small}/reading_label.parquet")
    levels = lambda **k: {r.doc_id: (r.reading_level, round(r.score, 6)) for r in reading.reading_levels(docs, labels, **k).collect()}
    sent = levels()
    monkeypatch.setattr(reading, "DICTIONARY", 0)
    assert levels() == sent and sent
    assert set(levels(rounds=0)) == set(sent)


def test_linkage_equal_names_by_how_many_have_them(spark):
    """One name more or less across the limit changes nothing; each power of ten is a level, at every size."""
    born = lambda i: dt.date(1960 + i % 50, 1 + i % 12, 2 + i % 20)
    person = lambda i, name: (i, name, born(i), "S", "SE", f"{chr(65 + i % 26)}ire{chr(97 + i % 26)}", f"{chr(65 + i % 25)}am{chr(97 + i % 25)}", None, "st", None, None)
    record = lambda i, name: (1000 + i, "hvt", name, f"{born(i).year}" if i % 2 else None, "Stute", "SE", None, None)
    home = [person(i, "Same Name") for i in range(141)] + [person(200, "Rare Bird")] + [person(300 + i, "Some Horses") for i in range(4)]
    raw = [record(200, "Rare Bird")] + [record(300 + i, "Some Horses") for i in range(4)]
    levels = []
    for n in (141, 142):  # 19,881 and 20,022 pairs
        more = [(2000 + i, "hvt", "Same Name", None, "Stute", "SE", f"Zz{chr(97 + i % 26)}{chr(97 + i // 26)}qx", None) for i in range(n)]
        (a, _), (b, _) = linkage.profiles(linkage.horse_traits(spark.createDataFrame(home, HORSE))), linkage.profiles(linkage.raw_traits(spark.createDataFrame(raw + more, RAW)))
        said = linkage.scored(a, b).join(a.select(F.col("pid").alias("l"), "name"), "l").join(b.select(F.col("pid").alias("r"), F.col("name").alias("other")), "r")
        levels.append({(r.name, r.v_name) for r in said.where("name = other").select("name", "v_name").distinct().collect()})
    assert levels[0] == levels[1] == {("RAREBIRD", 5), ("SOMEHORSES", 6), ("SAMENAME", 9)}


def test_judge_tells_every_source_apart(spark, monkeypatch):
    """The thirtieth source counts by its own quality, as do rows without a source; fitted on executors the same comes out."""
    rnd = random.Random(5)
    sources = [*(f"s{i:02d}" for i in range(30)), "other", None]
    good = {s: 0.2 if s in ("s28", "other") else 0.9 for s in sources}
    rows = []
    for i in range(500):
        for k, s in enumerate(sources if i == 0 else rnd.sample(sources, 6)):
            rows.append((i, i * 100 + k, s, "t" if rnd.random() < good[s] else f"f{rnd.randint(0, 5)}"))
    said = spark.createDataFrame(rows, "group_id int, row_id int, source string, value string").withColumns({"field_name": F.lit("name"), "key": F.col("value"), "seen": F.lit(None).cast("timestamp_ntz")})
    beliefs, quality = survivor.judge(said)
    assert {s for _, s in quality} == set(sources)
    assert all((quality["name", s][0] > 0.7) == (good[s] > 0.5) for s in sources)
    monkeypatch.setattr(survivor, "DRIVER_FIT", 0)
    apart, again = survivor.judge(said)
    place = lambda df: {(r.group_id, r.key): round(r.p, 6) for r in df.collect()}
    assert place(apart) == place(beliefs) and again.keys() == quality.keys()
    assert all(np.allclose(again[k], quality[k]) for k in quality)
