"""Language identification by rank-order n-gram profiles (operator 4).

A profile is the list of a language's most frequent character n-grams (1 to 5,
within words padded with a blank). A document's own most frequent n-grams are
compared with each profile by the out-of-place distance: the sum of differences
of ranks, with the greatest difference for n-grams that the profile lacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside

WORDS = re.compile(r"[^\W\d_]+")
#: Entries of a task's counters before they are handed on.
BOUND = 200_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams_of(word: str, longest: int) -> list[str]:
    """n-grams of a word's letters, padded with one blank on either side; the blank alone is none."""
    letters = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    if not letters:
        return []
    padded = f" {letters} "
    return [padded[i : i + n] for n in range(1, longest + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != " "]


@dataclass(frozen=True)
class Profiles:
    """langs in code point order; ranks[gram] has the gram's rank in each, or ``size`` where it has none."""

    langs: tuple[str, ...]
    ranks: dict[str, tuple[int, ...]]
    size: int
    longest: int


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = 400, longest: int = 5) -> Profiles:
    """Profiles from all rows of ``docs`` whose text and language aren't null.

    Tasks count words, Spark adds the counts up per language and word, each
    distinct word is cut into n-grams once, and the first ``size`` of each
    language by count, then by code points, are kept. Only those reach the
    driver: languages * size rows.
    """

    def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}

        def rows() -> pd.DataFrame:
            out = [(g, w, n) for g, c in found.items() for w, n in c.items()]
            found.clear()
            return pd.DataFrame(out, columns=["lang", "word", "n"])

        for frame in frames:
            for t, g in zip(frame["t"], frame["g"], strict=True):
                found.setdefault(g, Counter()).update(words_of(t))
                if sum(map(len, found.values())) > BOUND:
                    yield rows()
        yield rows()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def rows() -> pd.DataFrame:
            out = [(*k, n) for k, n in found.items()]
            found.clear()
            return pd.DataFrame(out, columns=["lang", "gram", "n"])

        for frame in frames:
            for g, w, n in zip(frame["lang"], frame["word"], frame["n"], strict=True):
                for gram in grams_of(w, longest):
                    found[g, gram] += n
                if len(found) > BOUND:
                    yield rows()
        yield rows()

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("g")).filter("t IS NOT NULL AND g IS NOT NULL")
    words = rows.mapInPandas(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInPandas(cut, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    langs = tuple(sorted({r["lang"] for r in top}))
    ranks: dict[str, list[int]] = {}
    for r in top:
        ranks.setdefault(r["gram"], [size] * len(langs))[langs.index(r["lang"])] = r["rank"] - 1
    return Profiles(langs, {g: tuple(v) for g, v in sorted(ranks.items())}, size, longest)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(text: str, longest: int) -> np.ndarray:
    """A 64-bit number for every n-gram of a text's words, repeats included; those of ``grams_of`` over all words.

    Words stand in one array with one blank between them; an n-gram is good if
    no blank lies inside it.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # letters, and what ends a word
    c = np.concatenate([[0], np.where(letter, codes, 0)[keep], [0]]).astype(np.uint64)
    blank = c == 0
    if blank.all():
        return np.empty(0, np.uint64)
    h = c + np.uint64(1)
    out, good = [h[~blank]], np.ones(len(c), bool)
    good[:-1] = ~(blank[:-1] & blank[1:])
    for n in range(2, longest + 1):
        if n > len(c):
            break
        h = h[:-1] * _FACTOR + (c[n - 1 :] + np.uint64(1))
        good = good[:-1] if n == 2 else good[:-1] & ~blank[n - 2 : len(c) - 1]
        out.append(h[good])
    return np.concatenate(out)


class Ranker:
    """Compares documents with profiles."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        names = {int(self._whole(g)): r for g, r in profiles.ranks.items()}
        self.keys = np.array(sorted(names), dtype=np.uint64)
        self.table = np.array([names[int(k)] for k in self.keys], dtype=np.float64).reshape(len(self.keys), len(profiles.langs))

    @staticmethod
    def _whole(gram: str) -> int:
        h = 0
        for ch in gram:
            h = (h * int(_FACTOR) + (0 if ch == " " else ord(ch)) + 1) % (1 << 64)
        return h

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its share of belief (a soft minimum of the mean distances)."""
        size = self.profiles.size
        found = _gram_hashes(text, self.profiles.longest) if text else ()
        if not len(found) or not self.profiles.langs:
            return UNKNOWN, 0.0
        grams, n = np.unique(found, return_counts=True)
        ordered = np.sort(n)[::-1]
        if len(ordered) > size:  # n-grams with fewer are out of the document's profile
            grams, n = grams[n >= ordered[size - 1]], n[n >= ordered[size - 1]]
        ordered = -np.sort(-n)
        above = np.searchsorted(-ordered, -n, "left")
        rank = np.minimum((above + np.searchsorted(-ordered, -n, "right") - 1) / 2, size)  # equal counts share their mean rank
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        known = self.keys[at] == grams
        theirs = self.table[at[known]]
        far = np.where(theirs < size, np.minimum(np.abs(theirs - rank[known][:, None]), size), size)
        distance = (far.sum(axis=0) + size * (~known).sum()) / (size * len(grams))
        best = int(np.argmin(distance))
        belief = np.exp(-30 * (distance - distance[best]))
        return self.profiles.langs[best], float(belief[best] / belief.sum())


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the whole text.

    ``und`` with score 0 if the text is null or has no letter, or if no language
    was learned. Ties go to the language first by code points. Columns of these
    names are replaced; other columns pass as they are. Rows are judged each for
    itself, so nothing is shuffled.
    """
    docs, names = aside(docs.drop("lang_pred", "score"))
    text = next((now for now, before in names.items() if before == text), text)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(profiles)
        for texts in batches:
            yield pd.DataFrame([ranker.judge(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("__j", judge(F.col(text))).select(*docs.columns, "__j.lang_pred", "__j.score").withColumnsRenamed(names)
