"""Reading level of each document, by a Rasch-style model of words and documents.

Every document has a latent level and every word a difficulty; a word is the likelier in a
document the nearer their places on the common scale: ``log rate = a_w + b_w * level``. The two
sides are estimated in turn. Given the levels, each word's parameters are fitted to its counts by
level (distributed over words); given the words, each document's level is read from the mean
difficulty of its words together with the length of its sentences and words, on the scale that
the judged documents fix. All documents take part, only those sums reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.runtime import Cut, cut, join_sized

# Function words by which a text's language is told.
FUNCTION_WORDS = {
    "sv": "och att det som på är med den av för till har inte om ett från efter men medan eftersom mot under",
    "en": "the and of in to is with for on at by was that from after but while because against under had",
    "fr": "le la les de du des et à un une en dans sur pour par que qui avec sans mais après malgré est",
    "de": "der die das und mit von im den dem ein eine zu auf für nach aber während weil trotz gegen ohne ist",
}
LANGUAGES = list(FUNCTION_WORDS)
_WHOSE = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words.split()}

TAG, LISTED = re.compile(r"<[^>]*>"), re.compile(r"\s*(?:\d+\s*[.|)]|\|)")
SENTENCE, WORD = re.compile(r"[^.!?\n]*[.!?]"), re.compile(r"[^\W\d_]+")
#: A sentence of running prose has at least so many words of two letters.
SENTENCE_WORDS = 3

#: Bins of the level scale in the word step, rounds of both steps, strength of the pull of rare words to no difficulty.
BINS, ROUNDS, RIDGE = np.linspace(1, 5, 9), 2, 2.0
#: Most words of a dictionary that is sent to every executor (16 bytes each).
DICTIONARY = 2_000_000
FEATURES = ["one", "log_mean", "mean_log", "letters", *(f"is_{x}" for x in LANGUAGES[1:])]


def repaired(text: str) -> str:
    """A text whose UTF-8 was read as a western code page, read rightly; others unchanged."""
    if "Ã" not in text and "â‚" not in text:
        return text
    out = []
    for line in text.split("\n"):  # one line beyond repair keeps no other from it
        try:
            out.append(line.encode("cp1252").decode("utf-8"))
        except UnicodeError:
            out.append(line)
    return "\n".join(out)


def sentence_words(text: str) -> list[list[str]]:
    """Words of each sentence of running prose: no markup, headings, list lines or fragments."""
    text = repaired(text).lower()
    if "<" in text:
        text = TAG.sub(" ", text)
    found = []
    for line in text.split("\n"):
        if LISTED.match(line):
            continue
        for s in SENTENCE.findall(line):
            words = WORD.findall(s)
            if len(words) >= SENTENCE_WORDS and sum(len(w) >= 2 for w in words) >= SENTENCE_WORDS:
                found.append(words)
    return found


class _Ids(dict):
    """Ids of words, remembered within a worker; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word) - (1 << 63)
        return made


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    id_of = _Ids()
    for b in batches:
        rows = []
        for doc, text in zip(b.doc_id, b.text, strict=True):
            words = sentence_words(text)
            if not words:
                continue
            n = np.array([len(w) for w in words], float)
            counts = Counter(chain.from_iterable(words))
            tongue = dict.fromkeys(LANGUAGES, 0)
            for w in counts.keys() & _WHOSE.keys():
                tongue[_WHOSE[w]] += counts[w]
            total = int(n.sum())
            letters = sum(map(len, chain.from_iterable(words))) / total
            rows.append((doc, max(LANGUAGES, key=tongue.get), float(np.log(n.mean())), float(np.log(n).mean()), letters, total, [id_of[w] for w in counts], list(counts.values())))
        yield pd.DataFrame(rows, columns=["doc_id", "lang", "log_mean", "mean_log", "letters", "total", "words", "counts"])


MEASURES = "doc_id bigint, lang string, log_mean double, mean_log double, letters double, total bigint, words array<bigint>, counts array<int>"
PLAIN = ["doc_id", "lang", "log_mean", "mean_log", "letters", "total"]


def measured(documents: DataFrame) -> DataFrame:
    """Sentence and word measures of each document with running prose, whole texts.

    Ids, nulls and repeats stay as they are; null, blank and list-only texts give no row.
    """
    return documents.select(F.col("doc_id").cast("bigint"), "text").where("text is not null and doc_id is not null").mapInPandas(_measure, MEASURES)


def _with_ones(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"one": F.lit(1.0), **{f"is_{x}": (F.col("lang") == x).cast("double") for x in LANGUAGES[1:]}})


def _linear(names: list[str], weights: np.ndarray) -> Column:
    return sum((F.col(c) * float(w) for c, w in zip(names, weights, strict=True)), F.lit(0.0))


def _link(docs: DataFrame, names: list[str], judged: DataFrame) -> np.ndarray | None:
    """Least-squares weights of the features on the judged levels; None without judgements."""
    rows = docs.join(judged, "doc_id")
    sums = [F.sum(F.col(a) * F.col(b) * F.col("w")).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    sums += [F.sum(F.col(a) * F.col("level") * F.col("w")).alias(f"y{i}") for i, a in enumerate(names)]
    got = rows.agg(*sums, F.count(F.lit(1)).alias("n")).first()
    if not got["n"]:
        return None
    k = len(names)
    left = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) + np.diag([1e-6] + [0.05] * (k - 1))
    return np.linalg.solve(left, np.array([got[f"y{i}"] for i in range(k)], float))


def _fit_words(batches: Iterator[pd.DataFrame], totals: np.ndarray) -> Iterator[pd.DataFrame]:
    """Poisson regression of each word's counts by level, all words of a batch at once."""
    x = BINS - BINS.mean()
    for b in batches:
        if b.empty:
            continue
        seen = np.zeros((len(b), len(BINS)))
        for i, (bins, counts) in enumerate(zip(b.bins, b.counts, strict=True)):
            np.add.at(seen[i], np.asarray(bins, int), np.asarray(counts, float))
        base, slope = np.log((seen.sum(1) + 0.5) / totals.sum()), np.zeros(len(b))
        for _ in range(15):
            rate = totals * np.exp(base[:, None] + slope[:, None] * x)
            g0, g1 = (seen - rate).sum(1), ((seen - rate) * x).sum(1) - RIDGE * slope
            h00, h01, h11 = rate.sum(1) + 1e-6, (rate * x).sum(1), (rate * x * x).sum(1) + RIDGE
            det = h00 * h11 - h01**2
            base, slope = base + np.clip((h11 * g0 - h01 * g1) / det, -1, 1), slope + np.clip((h00 * g1 - h01 * g0) / det, -1, 1)
        yield pd.DataFrame({"word": b.word, "difficulty": slope})


def word_step(docs: DataFrame, level: Column) -> Cut:
    """Difficulty of each word given the documents' levels: ``(word, difficulty)``.

    Counts by word and level are summed within each batch before they are shuffled.
    """
    at = F.round((F.greatest(F.least(level, F.lit(5.0)), F.lit(1.0)) - 1) * 2).cast("int")
    binned = docs.select(at.alias("bin"), "total", "words", "counts")
    totals = np.zeros(len(BINS))
    for r in binned.groupBy("bin").agg(F.sum("total").alias("n")).collect():
        totals[r.bin] = r.n

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b["words"].offsets.to_numpy())
            key = {"word": b["words"].flatten(), "bin": np.repeat(b["bin"].to_numpy(), sizes), "n": b["counts"].flatten().cast(pa.int64())}
            met = pa.table(key).group_by(["word", "bin"]).aggregate([("n", "sum")]).rename_columns(["word", "bin", "n"])
            yield from met.combine_chunks().to_batches()

    by_bin = binned.mapInArrow(tally, "word bigint, bin int, n bigint").groupBy("word", "bin").agg(F.sum("n").alias("n"))
    by_word = by_bin.groupBy("word").agg(F.collect_list("bin").alias("bins"), F.collect_list("n").alias("counts"))
    return cut(by_word.mapInPandas(lambda b: _fit_words(b, np.maximum(totals, 1e-9)), "word bigint, difficulty double"), "words")


def document_step(docs: DataFrame, words: Cut, with_words: bool = False) -> DataFrame:
    """Mean difficulty of each document's words: adds ``hardness``.

    Up to ``DICTIONARY`` words are sent to all executors and looked up beside the documents; a
    larger dictionary is joined. Both give the same.
    """
    if words.seen["rows"] > DICTIONARY:
        each = docs.select("doc_id", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("doc_id", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        met = join_sized(each, words, ["word"], F.col("doc_id"))
        mean = met.groupBy("doc_id").agg((F.sum(F.col("n") * F.col("difficulty")) / F.sum("n")).alias("hardness"))
        kept = docs if with_words else docs.select(*PLAIN)
        return kept.join(mean, "doc_id", "left").withColumn("hardness", F.coalesce("hardness", F.lit(0.0)))
    table = words.df.toPandas().sort_values("word")
    known = docs.sparkSession.sparkContext.broadcast((table.word.to_numpy(np.int64), table.difficulty.to_numpy(float)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, difficulty = known.value
        for b in batches:
            hardness = np.zeros(b.num_rows)
            if b.num_rows and len(ids):
                word, n = b["words"].flatten().to_numpy(), b["counts"].flatten().to_numpy().astype(float)
                at = np.minimum(np.searchsorted(ids, word), len(ids) - 1)
                n = np.where(ids[at] == word, n, 0.0)
                owner = np.repeat(np.arange(b.num_rows), np.diff(b["words"].offsets.to_numpy()))
                weight = np.bincount(owner, n, b.num_rows)
                hardness = np.bincount(owner, n * difficulty[at], b.num_rows) / np.where(weight > 0, weight, 1)
            if not with_words:
                b = b.select(PLAIN)
            yield b.append_column("hardness", pa.array(hardness))

    return docs.mapInArrow(look_up, (MEASURES if with_words else MEASURES.partition(", words")[0]) + ", hardness double")


def cut_points(scores: DataFrame, judged: DataFrame) -> list[float]:
    """The four scores that part the five levels with the fewest errors on judged documents."""
    points = [1.5, 2.5, 3.5, 4.5]
    seen = scores.join(judged, "doc_id").groupBy(F.round("score", 2).alias("s"), F.round("level").cast("int").alias("l")).agg(F.sum("w").alias("n")).where("s is not null").collect()
    for i, start in enumerate(points):
        near = [(r.s, r.l, r.n) for r in seen if r.l in (i + 1, i + 2)]

        def wrong(c: float, near: list = near, i: int = i) -> float:
            return sum(n for s, lv, n in near if (s >= c) != (lv == i + 2))

        points[i] = min((round(start + d / 100, 2) for d in range(-40, 41)), key=lambda c: (wrong(c), abs(c - start)))
    return points


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, lang, score, reading_level)`` for every document with running prose.

    ``labels`` holds judgements ``(doc_id, reading_level)``, several to a document, null where a
    judge saw no prose; their means fix the scale. Without any judgement the scale has no anchor
    and every document gets level 3. Repeated documents get equal levels.
    """
    raw = cut(measured(documents), "measured")
    docs = _with_ones(raw.df)
    judged = labels.where("reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level"), F.count(F.lit(1)).cast("double").alias("w"))
    judged = cut(judged, "judged").df
    weights = _link(docs, FEATURES, judged)
    if weights is None:
        return docs.select("doc_id", "lang", F.lit(3.0).alias("score"), F.lit(3).alias("reading_level"))
    level = _linear(FEATURES, weights)
    known = docs
    for _ in range(rounds):
        words = word_step(docs, level)
        known = _with_ones(cut(document_step(raw.df, words), "levels").df)
        docs = _with_ones(document_step(raw.df, words, with_words=True))
        level = _linear([*FEATURES, "hardness"], _link(known, [*FEATURES, "hardness"], judged))
    docs = known
    scores = docs.select("doc_id", "lang", level.alias("score"))
    c = cut_points(scores, judged)
    graded = F.lit(1) + sum(((F.col("score") >= x).cast("int") for x in c), F.lit(0))
    return scores.withColumn("reading_level", graded.cast("int"))
