"""Tolerant parsers of sources' texts, as built-in expressions inside code generation."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters(*ranges: tuple[int, int]) -> tuple[str, str]:
    """Letters with marks and their plain forms, by decomposition."""
    pairs = []
    for first, last in ranges:
        for c in map(chr, range(first, last + 1)):
            bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if bare != c and len(bare) == 1 and bare.isalpha():
                pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


# Letters that do not decompose and their plain forms, letters that become two, month names.
ATOMIC, ATOMIC_PLAIN = "ØøŁłĐđĦħıİŦŧŊŋ", "OoLlDdHhIITtNn"
MARKED, PLAIN = (x + y for x, y in zip((ATOMIC, ATOMIC_PLAIN), _plain_letters((0xC0, 0x24F), (0x370, 0x4FF), (0x1E00, 0x1EFF)), strict=True))
DOUBLED = [("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss"), ("ð", "d"), ("Ð", "D"), ("þ", "th"), ("Þ", "TH")]
MONTHS = ["januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december"]
WEEKDAYS = "Måndag|Tisdag|Onsdag|Torsdag|Fredag|Lördag|Söndag"
SEX_WORDS = {"stallion": "H", "gelding": "V", "mare": "S", "hingst": "H", "valack": "V", "sto": "S", "hongre": "V", "femelle": "S", "male": "H", "mâle": "H", "entier": "H", "v": "V", "g": "V", "f": "S"}
FRENCH_SEXES, GERMAN_SEXES = {"H": "V", "F": "S", "M": "H"}, {"Hengst": "H", "Stute": "S", "Wallach": "V"}
NAME_SUFFIX = r"[*·]+|\s*\([A-Z]{1,3}\)\s*$|\s*\?\s*$"
KM_TIME = r"^\*?(?:(\d+)[.,])?(\d{1,2}),(\d)[a-zA-Z]*$"
NO_TIMES = ["", "ug", "uag", "d", "da", "ag", "g", "-", "-l"]
PLACEHOLDERS = "^(ej färdigreg|ej fardigreg|ej regist|unnamed|no name|sans nom|ohne name|namnlös|namnlos|nimeton)"


def _part(text: Column, pattern: str, i: int) -> Column:
    got = F.regexp_extract(text, pattern, i)
    return F.when(got != "", got)


def _strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def strip_accents(text: Column) -> Column:
    """Plain letters for letters with marks, whether written as one sign or as letter and marks."""
    out = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), MARKED, PLAIN)
    for letter, two in DOUBLED:
        out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def normalize_name(name: Column) -> Column:
    """Upper case without marks, guest suffix, stars and repeated spaces; null and '' give ''."""
    bare = F.regexp_replace(strip_accents(name), NAME_SUFFIX, "")
    return F.coalesce(F.regexp_replace(F.upper(_strip(bare)), r"\s+", " "), F.lit(""))


def synth_id(country: Column, name: Column) -> Column:
    """Key of an animal known only by country and name; null without a name."""
    plain = normalize_name(name)
    return F.when(plain != "", F.concat(F.lit("x:"), F.upper(F.coalesce(country, F.lit("??"))), F.lit(":"), plain))


def km_time(text: Column) -> Column:
    """Time text as one number, minutes * 1000 + seconds * 10 + tenths; the minute is 1 unless given."""
    at, text = KM_TIME, _strip(text)
    minute = F.coalesce(_part(text, at, 1).try_cast("int"), F.lit(1))
    return minute * 1000 + _part(text, at, 2).try_cast("int") * 10 + _part(text, at, 3).try_cast("int")


def km_seconds(text: Column) -> Column:
    n = km_time(text)
    return F.floor(n / 1000) * 60 + F.pmod(n, F.lit(1000)) / 10.0


def money_kr(text: Column) -> Column:
    """Whole kronor of the first number in a text such as '84.700 kr'; null without digits there.

    Thousands may be parted by points or spaces; a second amount is not read.
    """
    run = F.regexp_extract(F.replace(_strip(F.replace(text, F.lit("\u00a0"), F.lit(" "))), F.lit("."), F.lit(" ")), r"[\d\s]+", 0)
    digits = F.regexp_replace(run, r"\s", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def position_distance(text: Column) -> Column:
    """'7/2140' as a struct of position and distance; a distance of 0 and missing parts are null."""
    at, text = r"^(\d*)/(\d+)$", _strip(text)
    distance = _part(text, at, 2).try_cast("int")
    return F.struct(_part(text, at, 1).try_cast("int").alias("position"), F.when(distance > 0, distance).alias("distance"))


def heading(text: Column) -> Column:
    """'Track Weekday D Month YYYY' as a struct of track and date.

    The whole text where no weekday stands, in any case of letters; no date for unknown months and days.
    """
    at, bare = rf"(?iu)^(.+?)\s+({WEEKDAYS})\s+(\d{{1,2}})\s+(\S+)\s+(\d{{4}})$", _strip(text)
    months = F.create_map(*chain.from_iterable((F.lit(m), F.lit(i + 1)) for i, m in enumerate(MONTHS)))
    month = F.try_element_at(months, F.lower(_part(bare, at, 4)))
    day = F.to_date(F.try_to_timestamp(F.concat_ws("-", _part(bare, at, 5), F.lpad(month.cast("string"), 2, "0"), F.lpad(_part(bare, at, 3), 2, "0")), F.lit("yyyy-MM-dd")))
    return F.struct(F.when(bare.rlike(at), _strip(_part(bare, at, 1))).when(text != "", text).alias("track"), F.when(month.isNotNull(), day).alias("date"))


def classify_placement(number: Column, display: Column) -> Column:
    """Placement and disqualification of a raw number and display text."""
    n, d = F.coalesce(number.try_cast("int"), F.lit(0)), F.lower(F.coalesce(_strip(display), F.lit("")))
    return F.struct(F.when(n > 0, n).alias("placement"), d.rlike("^d|^r[0-9]").alias("disqualified"))


def start_method(time_text: Column) -> Column:
    """A for an auto-start time ('14,4a'), V for any other; null for what is no time."""
    t = F.lower(_strip(time_text))
    suffix = F.regexp_replace(t, r"^\*?(?:\d+[.,])?\d{1,2},\d", "")
    return F.when(t.isNull() | t.isin(NO_TIMES), None).when(F.contains(suffix, F.lit("a")), "A").otherwise("V")


def french_rank(code: Column) -> Column:
    """Flags of a French rank code: broke gait, disqualified, withdrawn."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    far = c.rlike("^(DA|DM|DAI|D[0-9]?)$")
    return F.struct(far.alias("galopp"), (far | c.isin("A", "T")).alias("disqualified"), (c == "NP").alias("withdrawn"))


def country(code: Column) -> Column:
    c = F.upper(F.trim(code))
    return F.when(c.rlike("^[A-Z]{2}$"), c)


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def sex_hvs(word: Column) -> Column:
    """H, V or S of a sex word of any source language.

    The letters h, m and s mean different sexes in different languages and give null.
    """
    return _looked_up(SEX_WORDS, F.lower(_strip(word)))


def french_sex(letter: Column) -> Column:
    """H, V or S of a French letter (H is a gelding there); other texts stay as they are."""
    return F.coalesce(_looked_up(FRENCH_SEXES, F.upper(_strip(letter))), letter)


def german_sex(word: Column) -> Column:
    return _looked_up(GERMAN_SEXES, word)


def is_placeholder(name: Column) -> Column:
    """Whether a name says that there is none yet."""
    return F.coalesce(F.lower(name).rlike(PLACEHOLDERS), F.lit(False))


def swedish_time(seconds: Column) -> Column:
    """Seconds a km as Swedish sources write it: '10,9', or minutes and seconds from 120 s."""
    tenths = F.round(seconds * 10, 0).cast("bigint")
    short = F.when(tenths >= 600, tenths - 600).otherwise(tenths)
    plain = F.format_string("%02d,%d", (short / 10).cast("bigint"), F.pmod(short, F.lit(10)))
    long = F.format_string("%d'%02d\"%d", (tenths / 600).cast("bigint"), (F.pmod(tenths, F.lit(600)) / 10).cast("bigint"), F.pmod(tenths, F.lit(10)))
    return F.when((seconds > 0) & (tenths < 1200), plain).when(seconds > 0, long)


def clock_seconds(text: Column) -> Column:
    """Seconds in 1'13"5, 1:13,7 or 1.21,6; null without such a time."""
    at = r"(\d+)[':.](\d{2})[\",.](\d)"
    return _part(text, at, 1).try_cast("double") * 60 + _part(text, at, 2).try_cast("double") + _part(text, at, 3).try_cast("double") / 10


def german_date(text: Column) -> Column:
    at = r"(\d{2})\.(\d{2})\.(\d{4})"
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", _part(text, at, 3), _part(text, at, 2), _part(text, at, 1)), F.lit("yyyy-MM-dd")))


def placement_split(text: Column) -> Column:
    """'35 (8-3-4)' as starts, firsts, seconds and thirds."""
    at = r"^\s*(\d+)\s*(?:\((\d+)-(\d+)-(\d+)\))?"
    return F.struct(*(_part(text, at, i).try_cast("int").alias(n) for i, n in enumerate(("starts", "first", "second", "third"), 1)))


def better_name(a: Column, b: Column) -> Column:
    """The spelling that says more: any over none, a foreign suffix over none, mixed case over capitals, else ``a``.

    '(SE)' and '(SWE)' say nothing and go first. A suffix that only a spelling in capitals has is
    put behind the other spelling.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)\s*\((?:SE|SWE)\)\s*$", ""), r"\s+$", "")
    x, y = bare(a), bare(b)
    at = r"(\((?!SE\b|SWE\b)[A-Z]{2,3}\))\s*$"
    loud = lambda c: (F.upper(c) == c) & c.rlike(r"\p{L}")
    here, there = x.rlike(at), y.rlike(at)
    both = F.when(there & ~here & ~loud(x) & loud(y), F.concat_ws(" ", x, F.regexp_extract(y, at, 1))).when(there & ~here, y).when(here & ~there, x).when(loud(x) & ~loud(y), y).otherwise(x)
    empty = lambda c: c.isNull() | (c == "")
    return F.when(empty(a), F.when(~empty(b), b)).when(empty(b), a).otherwise(both)


def rotated_name(name: Column) -> Column:
    """'Goop Björn' as 'Björn Goop': the first word moves to the end."""
    words = F.split(F.trim(name), r"\s+")
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.concat(F.slice(words, 2, 100), F.slice(words, 1, 1)))).otherwise(F.trim(name))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(name)), "[^a-z0-9]", "")


def kr_text(amount: Column) -> Column:
    """1234567 as '1 234 567 kr'."""
    return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(" ")), F.lit(" kr"))


def permille(count: Column, total: Column, least: int = 7, low: int | None = None, high: int | None = None) -> Column:
    """A mean in thousandths, rounded half to even, null below the least sample, clamped."""
    out = F.when(count >= least, F.bround(total.cast("double") * 1000 / count, 0).cast("int"))
    if low is not None:
        out = F.greatest(out, F.when(out.isNotNull(), F.lit(low)))
    return F.least(out, F.when(out.isNotNull(), F.lit(high))) if high is not None else out


def to_milliseconds(text: Column) -> Column:
    """'1.21,6 min/km' in milliseconds."""
    return clock_seconds(text) * 1000


def no_sentinel(number: Column, limit: float = 1e7) -> Column:
    """Numbers above the limit stand for missing."""
    return F.when(number <= limit, number)


def iso_date(text: Column) -> Column:
    """The date in the first ten signs; null where they are none."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def iso_datetime(text: Column) -> Column:
    """Date and time without zone; a date alone is its midnight."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?([+-]\d{2}:?\d{2}|Z)?$"), text.try_cast("timestamp_ntz"))


def total_prize(text: Column) -> Column:
    """Kronor behind 'max total:'."""
    digits = F.regexp_replace(F.regexp_extract(text, r"(?i)max total:\s*([\d.\s]+)\s*kr", 1), r"[.\s]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def proposition(terms: Column) -> Column:
    """The terms of a race as one text, a line each; null without terms."""
    said = F.transform(F.filter(terms, lambda t: t.isNotNull() & (t != "")), _strip)
    return F.when(F.size(said) > 0, F.array_join(said, "\n"))


def placement_text(place: Column, finish_order: Column, disqualified: Column, galloped: Column, scratched: Column) -> Column:
    """Placement as the statistics read it: utg, d, a number, g without one, 0 for finishers without place."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    number = place.cast("string")
    broke = F.when(place >= 1, number).otherwise("g")
    return F.when(yes(scratched), "utg").when(yes(disqualified), "d").when(yes(galloped), broke).when(place.isNotNull(), number).when(finish_order.isNotNull(), "0")


def studbook_placement_text(placement: Column, disqualified: Column, galloped: Column, withdrawn: Column, display: Column) -> Column:
    """The same for sources that give a display text."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    number, shown = F.when(placement >= 1, placement.cast("string")), _strip(display)
    return F.when(yes(withdrawn), "utg").when(yes(disqualified), "d").when(yes(galloped), F.coalesce(number, F.lit("g"))).otherwise(F.coalesce(number, F.when(shown != "", shown)))


def broke_gait(time_text: Column) -> Column:
    """Whether a km-time ends in g."""
    return F.coalesce(F.lower(_strip(time_text)).endswith("g"), F.lit(False))


def shoe_code(reported: Column, front: Column, back: Column) -> Column:
    """1 barefoot, 2 shod behind, 3 shod in front, 4 all round; null where nothing is reported."""
    f, b = F.coalesce(front, F.lit(False)), F.coalesce(back, F.lit(False))
    return F.when(F.coalesce(reported, F.lit(False)), F.when(f & b, "4").when(f, "3").when(b, "2").otherwise("1"))


def swedish_placement(text: Column) -> Column:
    """'15e' as '15'; other codes without outer spaces."""
    t = _strip(text)
    return F.when(t.rlike("^[0-9]+e$"), F.regexp_replace(t, "e$", "")).otherwise(t)


def _without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \u00a0\u202f]", "")


def french_date(text: Column) -> Column:
    at, t = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", _strip(text)
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", _part(t, at, 3), F.lpad(_part(t, at, 2), 2, "0"), F.lpad(_part(t, at, 1), 2, "0")), F.lit("yyyy-MM-dd")))


def french_seconds(text: Column) -> Column:
    """Seconds a km in 1'13"5 or 1.13.5."""
    t = _strip(_without_spaces(text))
    at = F.when(t.rlike("^(\\d+)['\u2032](\\d+)[\"\u2033](\\d+)$|^(\\d+)[.,](\\d+)[.,](\\d+)$"), F.split(t, "['\u2032\"\u2033.,]"))
    return at[0].cast("double") * 60 + at[1].cast("double") + at[2].cast("double") / 10


def euros(text: Column) -> Column:
    """Whole euros in '12 345 €' or '6.038.408 €'; a comma parts the cents."""
    t = F.replace(F.replace(_strip(F.regexp_replace(_without_spaces(F.replace(text, F.lit("&euro;"), F.lit("€"))), "[€$£]", "")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.bround(t.try_cast("double"), 0).cast("bigint")


def french_place(text: Column) -> Column:
    """'2e' as the number 2 and its text; 0 has no number."""
    t = F.coalesce(_strip(text), F.lit(""))
    return F.struct(F.when(t != "0", F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")).alias("number"), t.alias("text"))


def sex_and_age(text: Column) -> Column:
    """'H10' as letter and age."""
    at, t = r"(?i)^([HFM])(\d+)$", _strip(text)
    return F.struct(F.upper(_part(t, at, 1)).alias("sex"), _part(t, at, 2).try_cast("int").alias("age"))


def suffix_country(name: Column) -> Column:
    """Country of a name such as 'Nuncio (US)'."""
    return _part(name, r"\(([A-Z]{2})\)\s*$", 1)


def german_seconds(text: Column) -> Column:
    """Seconds a km in 1:13,7."""
    at, t = r"^(\d+):(\d+)[,.](\d+)$", _strip(text)
    return _part(t, at, 1).cast("double") * 60 + _part(t, at, 2).cast("double") + _part(t, at, 3).cast("double") / 10


def race_key(text: Column) -> Column:
    """'YYYY-MM-DD_track_n' as date, track and number; all null for other texts."""
    at = r"^(\d{4}-\d{2}-\d{2})_(-?\d+)_(-?\d+)$"
    day = _part(text, at, 1).try_cast("date")
    known = lambda c: F.when(day.isNotNull(), c)
    return F.struct(day.alias("date"), known(_part(text, at, 2).try_cast("int")).alias("track"), known(_part(text, at, 3).try_cast("int")).alias("number"))


STATISTICS = "struct<statistics:array<struct<year:string,numberOfStarts:string,placements:string,prizeMoney:string,mark:string>>>"


def lifetime(text: Column) -> Column:
    """Starts, wins, prize money and record of the row 'Livs' in a JSON of yearly statistics."""
    row = F.get(F.filter(F.from_json(text, STATISTICS)["statistics"], lambda r: r["year"] == "Livs"), F.lit(0))
    prize = F.regexp_replace(F.regexp_extract(F.replace(row["prizeMoney"], F.lit("\u00a0"), F.lit(" ")), r"[\d\s]+", 0), r"\s", "")
    return F.struct(
        row["numberOfStarts"].try_cast("int").alias("starts"), F.split(row["placements"], "-")[0].try_cast("int").alias("wins"), prize.try_cast("bigint").alias("prize_money_kr"), F.when(row["mark"] != "", row["mark"]).alias("record"),
    )


def race_title(name: Column) -> Column:
    """A race's name without brackets, what stands behind the last ' - '."""
    plain = F.regexp_replace(_strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", "")), r"\s+", " ")
    return _strip(F.substring_index(plain, " - ", -1))


def distance_label(distance: Column, method: Column) -> Column:
    """'2140m volt'; null without a distance."""
    m = F.lower(F.coalesce(_strip(method), F.lit("")))
    m = F.when(m == "volte", "volt").otherwise(m)
    return F.when(F.coalesce(distance, F.lit(0)) != 0, F.concat(distance.cast("string"), F.lit("m"), F.when(m != "", F.concat(F.lit(" "), m)).otherwise("")))


def track_name(name: Column) -> Column:
    """Track names in capitals or small letters with a capital at each word, after hyphens too."""
    s = _strip(name)
    words = F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap)
    return F.when((s != "") & ((s == F.upper(s)) | (s == F.lower(s))), F.array_join(words, "")).when(s != "", s).otherwise(name)


def birth_year(born: Column, age: Column, race_date: Column) -> Column:
    """Year of birth, or the year of a race less the age stated there."""
    return F.coalesce(F.year(born), F.when(age != 0, F.year(race_date) - age))


def short_name(name: Column) -> Column:
    """'Svensson Erik Karl' as 'Sve EK'."""
    words = F.filter(F.split(F.coalesce(_strip(name), F.lit("")), r"\s+"), lambda w: w != "")
    head = F.initcap(F.substring(F.get(words, F.lit(0)), 1, 3))
    initials = F.array_join(F.transform(F.slice(words, 2, 1000), lambda w: F.upper(F.substring(w, 1, 1))), "")
    rest = F.when(F.size(words) == 2, F.initcap(F.substring(F.get(words, F.lit(1)), 1, 2))).otherwise(initials)
    return F.when(F.size(words) == 0, "").when(F.size(words) == 1, head).otherwise(F.concat_ws(" ", head, rest))


def live_odds(hundredths: Column) -> Column:
    """Odds of a pool, given in hundredths; null unless above 0."""
    return F.when(hundredths > 0, F.bround(hundredths.cast("double") / 100, 2))


def percent(count: Column, total: Column) -> Column:
    """A share in percent with one decimal, rounded half to even; null over nothing."""
    return F.bround(F.lit(100.0) * count / F.when(total != 0, total), 1)


def gender_label(code: Column) -> Column:
    return _looked_up({"H": "stallion", "V": "gelding", "S": "mare"}, code)


def page_limits(limit: int | None, offset: int | None, default: int = 50, most: int = 200) -> tuple[int, int]:
    """Rows of a page and rows before it, as a request may ask for them."""
    return min(most, max(1, limit if limit is not None else default)), max(0, offset or 0)
