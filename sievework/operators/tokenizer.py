"""Byte-pair merges learned and applied over distinct words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sievework.functions.columns import ratio, words
from sievework.operators.text import squeeze
from sievework.session import cut

# Marks before and after each symbol, so that a merge never touches the next one.
_A, _Z = "\u0001", "\u0002"
_BETWEEN = _Z + _A
_HELD = 1 << 20


def word_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(squeeze(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _spelled(words_: Sequence[str], merges: Sequence[tuple[str, str]]) -> list[str]:
    """Words with every symbol between two marks, after the merges in their order.
    All words are one text, as they hold no line ends, so a merge is one replacement."""
    text = "\n".join([_A + _BETWEEN.join(w) + _Z for w in words_])
    for a, b in merges:
        text = text.replace(f"{_A}{a}{_BETWEEN}{b}{_Z}", f"{_A}{a}{b}{_Z}")
    return text.split("\n")


def _pairs(vocab: DataFrame, before: Sequence[tuple[str, str]], batch: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(a, b, c): adjacent symbols with their words' counts under the merges
    ``before``; with a ``batch`` of further merges, what these change in the counts.
    Words are spelled where they are needed, and a task adds up its own words."""
    if batch:
        vocab = vocab.where(reduce(lambda x, y: x | y, [F.contains("word", F.lit(a + b)) for a, b in batch]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], int] = defaultdict(int)
        for d in batches:
            old = _spelled(d["word"].tolist(), before)
            new = _spelled(d["word"].tolist(), [*before, *batch]) if batch else old
            for s, t, n in zip(old, new, d["n"].tolist()):
                if not batch or s != t:
                    for text, c in ((s, -n), (t, n)) if batch else ((s, n),):
                        p = text[1:-1].split(_BETWEEN)
                        for z in zip(p, p[1:]):
                            sums[z] += c
            if len(sums) > _HELD:
                yield pd.DataFrame([(a, b, c) for (a, b), c in sums.items()], columns=["a", "b", "c"])
                sums.clear()
        if sums:
            yield pd.DataFrame([(a, b, c) for (a, b), c in sums.items()], columns=["a", "b", "c"])

    return vocab.select("word", "n").mapInPandas(run, "a string, b string, c bigint")


def independent(top: Sequence[tuple[str, str, int]], whole: bool) -> list[tuple[str, str, int]]:
    """The first pairs of a sorted list that are the next merges for certain.

    A merge changes the counts only of pairs that share a symbol with it, and the
    new pairs it makes occur no more often than those. So the next pair is certain
    while no pair that touches an earlier choice occurs as often. A pair of equal
    symbols can make pairs as frequent as itself and ends the choice, and so does
    the count at which a list that is not ``whole`` was cut."""
    out: list[tuple[str, str, int]] = []
    used: set[str] = set()
    end = None if whole else top[-1][2]
    for a, b, c in top:
        touching = any(x in used or y in used for x, y, n in top if n >= c and (x, y) not in {o[:2] for o in out})
        if c < 2 or touching or (out and c == end):
            break
        out.append((a, b, c))
        used |= {a, b}
        if a == b:
            break
    return out


def train_bpe(df: DataFrame, text: str, merges: int, every: int = 8, listed: int = 256) -> list[tuple[str, str, int]]:
    """Merge table [(left, right, count)]: the most frequent adjacent pair, ties
    to the smaller pair, until ``merges`` or no pair occurs twice.

    The corpus is read once into word counts and pair counts. A round takes the
    ``listed`` most frequent pairs to the driver and merges all of them that cannot
    influence each other; only words that hold the letters of a merged pair are
    spelled, and the differences of their pairs are added to the counts. Nothing
    but words and pair counts is stored."""
    v = cut(word_counts(df, text).where(F.length("word") > 1))
    total = lambda d: d.groupBy("a", "b").agg(F.sum("c").alias("c"))
    counts, extra = cut(total(_pairs(v, []))), []
    out: list[tuple[str, str, int]] = []
    rounds = 0
    while len(out) < merges:
        now = total(reduce(DataFrame.unionByName, [counts, *extra])) if extra else counts
        top = [(r["a"], r["b"], r["c"]) for r in now.where("c > 1").orderBy(F.desc("c"), "a", "b").limit(listed).collect()]
        batch = independent(top, len(top) < listed)[: merges - len(out)] if top else []
        if not batch:
            break
        made = [(a, b) for a, b, _ in out]
        out += batch
        if len(out) >= merges:
            break
        extra.append(cut(total(_pairs(v, made, [(a, b) for a, b, _ in batch])).where("c <> 0")))
        rounds += 1
        if rounds % every == 0:
            counts, extra = cut(total(reduce(DataFrame.unionByName, [counts, *extra])).where("c > 0")), []
    return out


def encode_words(vocab: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """(word, pieces) for distinct words; the merge table goes with the task."""
    rank = {(a, b): i for i, (a, b) in enumerate(merges)}

    def one(word: str) -> list[str]:
        p = list(word)
        while len(p) > 1:
            best = min(range(len(p) - 1), key=lambda i: rank.get((p[i], p[i + 1]), len(rank)))
            pair = (p[best], p[best + 1])
            if pair not in rank:
                break
            q, i = [], 0
            while i < len(p):
                if i + 1 < len(p) and (p[i], p[i + 1]) == pair:
                    q.append(p[i] + p[i + 1])
                    i += 2
                else:
                    q.append(p[i])
                    i += 1
            p = q
        return p

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "pieces": b["word"].map(one)})

    return vocab.select("word").mapInPandas(run, "word string, pieces array<string>")


def fertility(df: DataFrame, text: str, by: str, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """By group: words, pieces per word against the character baseline, share of
    single-character pieces, and words that do not decode back."""
    counts = df.select(by, F.explode(words(squeeze(F.col(text)))).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    enc = cut(encode_words(counts.select("word").distinct(), merges))
    j = counts.join(enc, "word")
    p, n = F.size("pieces"), F.col("n")
    one = F.size(F.filter("pieces", lambda x: F.length(x) == 1))
    return j.groupBy(by).agg(
        F.sum(n).alias("words"), F.round(ratio(F.sum(n * p), F.sum(n)), 6).alias("pieces_per_word"), F.round(ratio(F.sum(n * F.length("word")), F.sum(n)), 6).alias("chars_per_word"),
        F.round(ratio(F.sum(n * one), F.sum(n * p)), 6).alias("single_char_share"), F.count_if(F.array_join("pieces", "") != F.col("word")).alias("broken_words"),
    )
