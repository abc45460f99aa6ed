"""Reading a quantity's text: dynamic programming over tries of prefixes, roots and exponents.

A text is first masked (every digit of a number becomes ``9``), so that the few distinct shapes
of a column are parsed once and the numbers are taken from the rows by built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# What the tokens of unit strings mean.
PREFIXES = {"tusen": 3, "t": 3, "k": 3, "mille": 3, "m": -3, "c": -2}
EXPONENTS = {"cents": -2, "cent": -2, "øre": -2, "öre": -2, "e-1": -1, "e-2": -2, "e-3": -3, "e2": 2, "e3": 3}
MONEY_ROOTS = {"kr": "kr", "kronor": "kr", "sek": "SEK", "nok": "NOK", "nkr": "NOK", "dkk": "DKK", "dkr": "DKK", "eur": "EUR", "euro": "EUR", "€": "EUR", "usd": "USD", "us$": "USD", "$": "USD"}
TIME_ROOTS = {"s": "s", "sek": "s", "sec": "s", "min": "min"}
LENGTH_ROOTS = {"m": 1.0, "mi": 1609.344, "mile": 1609.344, "miles": 1609.344}
WHOLE = ["tot", "total", "ges", "gesamt"]
GAITS = ["a", "g", "ag"]
#: How well a kind of token suits a field's dimension; what is not listed suits badly.
PRIORS = {
    "money": {"money": 0.0, "exponent": -0.5, "prefix": -0.5, "grouped": -0.2, "plain": -0.3, "decimal": -1.0},
    "time": {"time": 0.0, "length": -0.3, "whole": 0.0, "gait": -0.4, "clock": -0.2, "decimal": -0.3, "plain": -0.8, "prefix": -0.5},
}
UNSUITED, UNKNOWN, PER_TOKEN = -6.0, -9.0, -1.0

NUMBERS = [("clock", re.compile(r"9[.:']99[.,\"]9+")), ("grouped", re.compile(r"9{1,3}(?:[ .,  ]999)+(?!9)")), ("decimal", re.compile(r"9+[.,]9{1,2}(?!9)")), ("plain", re.compile(r"9+"))]


def _trie(words: dict[str, list]) -> dict:
    root: dict = {}
    for word, values in words.items():
        at = root
        for c in word:
            at = at.setdefault(c, {})
        at.setdefault("", []).extend(values)
    return root


def _lexicon() -> dict:
    words: dict[str, list] = {}
    for kind, table in (("prefix", PREFIXES), ("exponent", EXPONENTS), ("money", MONEY_ROOTS), ("time", TIME_ROOTS), ("length", LENGTH_ROOTS), ("whole", {w: w for w in WHOLE}), ("gait", {g: g for g in GAITS})):
        for word, value in table.items():
            words.setdefault(word, []).append((kind, value))
    return _trie(words)


LEXICON = _lexicon()


@dataclass
class Reading:
    """How the numbers of a shape make a quantity."""

    form: str = ""  # plain, short (minute implied) or clock
    groups: int = 0  # digit groups that make the number
    decimals: int = 0  # digits after its decimal mark
    exponent: int = 0  # power of ten it is multiplied by
    currency: str = ""
    per: str = ""  # km, mile, whole (the row's distance) or stated (the text's)
    score: float = 0.0


def segment(shape: str, dimension: str) -> tuple[float, list[tuple[str, object, str]]]:
    """The best split of a shape into tokens ``(kind, value, text)`` for a field's dimension.

    The state is the place in the text and the kind of token that ends there, as what a token costs
    may depend on the one before it.
    """
    text, priors = shape.lower(), PRIORS[dimension]
    best: list[dict[str, tuple[float, list]]] = [{"": (0.0, [])}] + [{} for _ in text]

    def offer(start: int, end: int, kind: str, value: object, cost: float, after: tuple[str, ...] = ()) -> None:
        for before, (score, tokens) in best[start].items():
            now = score + cost + (UNSUITED if after and before not in after else 0)
            if kind not in best[end] or now > best[end][kind][0]:
                best[end][kind] = (now, [*tokens, (kind, value, text[start:end])])

    for i, c in enumerate(text):
        if c in " /.\u00a0\u202f()-:":
            offer(i, i + 1, "gap", c, 0.0)
        for kind, pattern in NUMBERS:
            if (i == 0 or text[i - 1] != "9") and (m := pattern.match(text, i)):
                offer(i, m.end(), kind, None, priors.get(kind, UNSUITED) + PER_TOKEN)
        at = LEXICON
        for j in range(i, len(text)):
            at = at.get(text[j])
            if at is None:
                break
            for kind, value in at.get("", ()):
                rooted = kind != "prefix" or (j + 1 < len(text) and text[j + 1] not in "/.")
                offer(i, j + 1, kind, value, priors.get(kind, UNSUITED) + PER_TOKEN + (0 if rooted else UNSUITED), ("clock", "decimal") if kind == "gait" else ())
        offer(i, i + 1, "unknown", c, UNKNOWN)
    return max(best[-1].values(), key=lambda x: x[0])


def read_shape(shape: str, dimension: str) -> Reading | None:
    """The reading of a masked text in a field of the given dimension, None if it states none."""
    score, tokens = segment(shape, dimension)
    numbers = [t for t in tokens if t[0] in ("clock", "grouped", "decimal", "plain")]
    kinds = [t[0] for t in tokens]
    if not numbers or "unknown" in kinds:
        return None
    kind, _, text = numbers[0]
    r = Reading(groups=len(re.findall("9+", text)), score=score)
    if kind == "decimal":
        r.decimals = len(re.findall("9+", text)[-1])
    units = [t for t in tokens if t[0] not in ("gap", "clock", "grouped", "decimal", "plain")]
    if dimension == "money":
        roots = [t[1] for t in units if t[0] == "money"]
        small = [t[2] for t in units if t[0] == "exponent" and t[2] in ("øre", "öre")]
        if len(numbers) != 1 or kind == "clock" or len(set(roots)) > 1 or not (roots or small):
            return None
        r.form, r.currency = "plain", str(roots[0]) if roots else "kr"
        r.exponent = sum(int(t[1]) for t in units if t[0] in ("prefix", "exponent"))
        return r
    r.form = "clock" if kind == "clock" else "plain"
    lengths = [i for i, t in enumerate(units) if t[0] == "length"]
    seconds = any(t[0] == "time" for t in units)
    if len(numbers) == 2:  # a time, then the distance it was run over
        if numbers[1][0] != "plain" or not lengths or units[lengths[0]][2] != "m":
            return None
        r.per = "stated"
    elif len(numbers) > 2:
        return None
    elif any(t[0] == "whole" for t in units):
        r.per = "whole"
    elif lengths and units[lengths[0]][1] == LENGTH_ROOTS["mile"]:
        r.per = "mile"
    else:
        r.per = "km"
        if kind == "decimal" and not seconds and len(re.findall("9+", text)[0]) <= 2:
            r.form = "short"
    if kind in ("plain", "grouped"):
        return None  # a bare whole number states no time
    return r
