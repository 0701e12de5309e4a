"""Spelling variants: words within one edit of a far more frequent word, found by dynamic programming over sorted lists.

A sorted list of words is scanned once for each of its words: the rows of the edit matrix, a band of three cells each, stay on
a stack, and the next word of the list reuses those of the prefix it shares with the one before (their LCP). A row whose cells
all exceed one edit ends the word and skips every following word that shares so long a prefix.

The vocabulary is cut into lists by what one edit leaves alone. Of two words within one edit, the shorter of length L, either the
first L // 2 code points are equal or the last; so a word stands in the list of its head and in that of its tail, for L as the shorter
and for L - 1 as the longer word. A list of more than LIST words is cut again in the same way, by the halves of what is not yet
fixed, until a window of one code point is left, so no list grows with the vocabulary. A pair is counted in one list only: that
of its tail requires a common prefix shorter than the head's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, small, stage

#: Words of a list at most, unless all but one code point is fixed.
LIST = 2000
LETTERS = "[a-zÀ-ÿ]+"
TOP = chr(0x10FFFF)
KEY = ["L", "cap", "head", "tail"]


def runs_of_letters(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of A-Z, a-z and U+00C0 to U+00FF of the texts, A-Z lower-cased, as often as it occurs. A null text has none."""
    text = lower_az(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))


def near_pairs(rests: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j: places of a sorted list of different strings that are one edit apart."""
    n = len(rests)
    common = [0] * n  # with the string before
    for j in range(1, n):
        a, b = rests[j - 1], rests[j]
        d, most = 0, min(len(a), len(b))
        while d < most and a[d] == b[d]:
            d += 1
        common[j] = d
    for i in range(n - 1):
        a = rests[i]
        size = len(a)
        # rows[d]: edits from the first d - 1, d and d + 1 code points of a to the first d of the list's string; 2 stands for more than one
        rows = [(2, 0, 1)] * (size + 2)
        known, j = 0, i + 1
        while j < n:
            b = rests[j]
            known = min(known, common[j])
            dead = 0
            x, y, z = rows[known]
            for d in range(known, len(b)):
                c = b[d]
                if d < size:
                    u = y + 1
                    if d and a[d - 1] == c:
                        u = min(u, x)
                    v = y if a[d] == c else min(u, y, z) + 1
                    w = 2
                    if d + 1 < size:
                        w = z if a[d + 1] == c else min(v, z) + 1
                else:
                    u, v, w = (min(y + 1, x + (a[d - 1] != c)) if 0 < d == size else y + 1 if d == size else 2), 2, 2
                if u > 1 and v > 1 and w > 1:
                    dead = d + 1
                    break
                x, y, z = rows[d + 1] = u, v, w
            if dead:
                known = dead - 1
                j += 1
                if j < n and common[j] >= dead:
                    j = bisect_left(rests, b[:dead] + TOP, j + 1)
                continue
            known = len(b)
            at = size - known + 1
            if 0 <= at <= 2 and rows[known][at] == 1:
                yield i, j
            j += 1


def _window(word: Column) -> Column:
    """What of a word its list does not fix."""
    return F.substring(word, F.length("head") + 1, F.length(word) - F.length("head") - F.length("tail"))


def _cut(lists: DataFrame) -> DataFrame:
    """Each (word, n, L, cap, head, tail) in two lists: with the first half of the window fixed, or the last."""
    half = F.floor((F.col("L") - F.length("head") - F.length("tail")) / 2).cast("int")
    kept = [F.col(c) for c in ("word", "n", "L")]
    longer = F.length("head") + half
    first = F.struct(F.col("cap"), F.substring("word", F.lit(1), longer).alias("head"), F.col("tail"))
    last = F.struct(longer.alias("cap"), F.col("head"), F.right("word", F.length("tail") + half).alias("tail"))
    return lists.select(*kept, F.explode(F.array(first, last)).alias("in")).select("word", "n", "L", "in.*")


def lists_of(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """(word, n, L, cap, head, tail): the lists that words of (word, n) stand in. cap: the common prefix of a pair counted there is shorter; 0 for any."""
    length = F.length("word")
    whole = vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("L"), F.lit(0).alias("cap"), F.lit("").alias("head"), F.lit("").alias("tail"))
    now, done = _cut(whole.where("L > 0")), []
    while True:
        large = now.groupBy(KEY).count().where((F.col("count") > most) & (F.col("L") - F.length("head") - F.length("tail") >= 2)).drop("count")
        large = stage(large, "large-lists")
        if large.isEmpty():
            break
        large = small(large, F.length("head") + F.length("tail"))
        done.append(now.join(large, KEY, "left_anti"))
        now = stage(_cut(now.join(large, KEY, "left_semi")), "cut-lists")
    for d in done:
        now = now.unionByName(d)
    return now


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole lists, sorted -> (word, near, form_n, form): how many near words a word has in a list, and its most frequent one."""
    now, held = None, []

    def found() -> dict[str, list]:
        out: dict[str, list] = {}
        L, cap = now[0], now[1]
        head = len(now[2])
        for i, j in near_pairs([h[0] for h in held]):
            (a, u, m), (b, v, n) = held[i], held[j]
            if len(u) > L and len(v) > L:  # in the lists of L + 1
                continue
            if cap:
                d, most = 0, min(len(a), len(b))
                while d < most and a[d] == b[d]:
                    d += 1
                if head + d >= cap:  # in the list of the head
                    continue
            for word, n_other, other in ((u, n, v), (v, m, u)):
                best = out.setdefault(word, [0, 0, ""])
                best[0] += 1
                if n_other > best[1] or n_other == best[1] and other < best[2]:
                    best[1:] = n_other, other
        return out

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) if made else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "form_n", "form"])

    for batch in batches:
        made: list[tuple] = []
        for L, cap, head, tail, rest, word, n in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            key = (L, cap, head, tail)
            if key != now:
                if len(held) > 1:
                    made += [(w, *b) for w, b in found().items()]
                now, held = key, []
            held.append((rest, word, n))
        yield batch_of(made)
    if len(held) > 1:
        yield batch_of([(w, *b) for w, b in found().items()])


def near_words(vocabulary: DataFrame, most: int = LIST) -> DataFrame:
    """(word, n_near, best_n, best): for each word of (word, n) with near words their number, and the one of largest n (ties: smallest in code-point order)."""
    lists = lists_of(vocabulary, most).withColumn("rest", _window(F.col("word")))
    lists = lists.repartition(*KEY).sortWithinPartitions(*KEY, "rest").select(*KEY, "rest", "word", "n")
    found = lists.mapInArrow(_scan, "word string, near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("cost"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("best")).select("word", "n_near", (-F.col("best.cost")).alias("best_n"), F.col("best.form").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): where the forms lead to. A step at least doubles a word's count, so chains are short; each round doubles the steps taken."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, least_chars: int = 5, least_n: int = 3, ratio: int = 2, most: int = LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words of `words` (a column word, a row for each occurrence) with
    least_chars code points and least_n occurrences or more.

    Two words are near if exactly one inserted, deleted or replaced code point sets them apart. form: the near word of largest n (ties:
    smallest in code-point order) if that n >= ratio * the word's, else null; form_n: its n. root: where the forms lead to from the word; the word
    itself without one. n_near: the number of near words. Null words don't count; other columns are ignored; an empty table gives an empty result.
    ratio has to be 2 or more, so that forms never lead back.
    """
    counts = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
    vocabulary = stage(counts, "vocabulary")
    near = near_words(vocabulary, most)
    named = vocabulary.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    named = stage(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "forms")
    root = roots(named.where("form is not null"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
