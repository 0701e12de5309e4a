"""Benchmark decontamination: a broadcast hash set of benchmark word windows, met by every window of the documents.

DataFrame functions only. Documents are hashed window by window inside their row; hits are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import counted_bytes, let, lower_az, packed, small, stage, unpacked

WINDOW = 13
#: What separates the words of a text whose A-Z are lower-cased, and what separates them in the text as it is.
GAP, GAP_AS_IS, WORD_AS_IS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The hash set is broadcast up to this many bytes, counted as small() counts (some 2 million windows); beyond, in parts of that size, with a pass over the
#: documents for each. So are the marks of documents with hits; beyond, their rows are met by a shuffle.
BROADCAST_HASHES = 64 << 20


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), GAP), "")


def _hash(w: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(w, at + j) for j in range(length)))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, w, n, items): each distinct window's hash, words and number of words, and what stands for the set of the items that have it: a
    count and two checksums. An item of fewer words, but not none, is one window."""
    found = _owned(benchmark, window).groupBy("w").agg(_item_set().alias("items"))
    return found.select(_by_length(window).alias("h"), "w", F.size("w").alias("n"), "items")


def _owned(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, w), once for each item and window."""
    w = F.col("w")
    cut = F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - window + 1, F.lit(1))), lambda i: F.slice(w, i, window))).otherwise(F.array(w))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.select("item", F.explode(cut).alias("w")).distinct()


def _item_set() -> Column:
    return F.struct(F.count("item").alias("c"), F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64("item"))).alias("a"), F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(7)))).alias("b"))


def _by_length(window: int) -> Column:
    return F.coalesce(*(F.when(F.size("w") == n, _hash(F.col("w"), F.lit(0), n)) for n in range(1, window + 1)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, items (sorted strings), hit_words (sorted positions from 0) and contaminated.

    A document word inside any occurrence of a benchmark window is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    A null or empty text has no words and no hits; an empty benchmark hits nothing; items with a null item_id hit words but
    are not listed. Rows that repeat are answered alike. Columns with the names of the results, in whatever case, are replaced.
    """
    return unpacked(_contaminated(docs, benchmark, window), "n_words", "n_hit", "items", "hit_words", "contaminated")


def _contaminated(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Documents meet the hashes window by window, without a shuffle; the few hits are staged. Only documents that have some are cut into words
    again, to compare the words themselves. The item sets of windows are joined in the end, once for each document and set."""
    windows = stage(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect()) or [window]  # at most `window` numbers
    rows = packed(docs, doc=F.col("doc_id"), text=F.col("text"), mark=F.xxhash64("text"))

    def hashes(w: Column, n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: _hash(w, i, n))).otherwise(F.expr("cast(array() as array<bigint>)"))

    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("text"), F.xxhash64("text").alias("mark")).where("text is not null")
    w = item_words(F.col("text"))
    if len(lengths) == 1:
        scan = texts.select("doc", "mark", F.lit(lengths[0]).alias("n"), let(w, lambda w: hashes(w, lengths[0])).alias("all"))
    else:
        scan = texts.select("doc", "mark", F.explode(let(w, lambda w: F.array(*(F.struct(F.lit(n).alias("n"), hashes(w, n).alias("all")) for n in lengths)))).alias("s")).select("doc", "mark", "s.*")
    scan = scan.select("doc", "mark", "n", F.posexplode("all").alias("pos", "h"))
    hashes_ = stage(windows.select("h").distinct(), "hashes")
    passes = max(1, -(-counted_bytes(hashes_) // BROADCAST_HASHES)) if BROADCAST_HASHES else 1
    parts = [F.broadcast(hashes_.where(F.pmod("h", F.lit(passes)) == i)) if BROADCAST_HASHES else hashes_ for i in range(passes)]
    hits = scan.join(parts[0], "h")
    for part in parts[1:]:
        hits = hits.unionByName(scan.join(part, "h"))
    hits = stage(hits, "hits")
    same = lambda a, b: a.doc.eqNullSafe(b.doc) & (a.mark == b.mark)
    places = stage(hits.groupBy("doc", "mark").agg(F.collect_set(F.struct("pos", "n", "h")).alias("places")), "places")  # a document's own
    few = small(places, 24 * F.size("places"))
    marks = small(stage(places.select("mark").distinct(), "marks"), bytes_=BROADCAST_HASHES)
    with_hits = texts.join(marks, "mark", "left_semi")  # so that only their texts are shuffled where the hits are not broadcast
    seen = with_hits.join(few, same(with_hits, few)).select(few.doc, few.mark, w.alias("all"), F.explode("places").alias("p"))
    seen = seen.select("doc", "mark", "p.*", F.slice("all", F.col("p.pos") + 1, F.col("p.n")).alias("w"))
    known = small(windows, 16 * F.col("n"), BROADCAST_HASHES)
    good = stage(seen.join(known, ["h", "w"]).select("doc", "mark", "pos", seen.n, "items"), "verified")
    of_set = _owned(benchmark, window).join(windows, "w").where("item is not null").select("items", "item").distinct()
    named = good.select("doc", "mark", "items").distinct().join(of_set, "items").groupBy("doc", "mark").agg(F.array_sort(F.collect_set("item")).alias("names"))
    spans = F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)))
    per = good.groupBy("doc", "mark").agg(F.array_sort(F.array_distinct(spans)).alias("hit_words"))
    per = per.join(named.withColumnsRenamed({"doc": "d", "mark": "m"}), F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select("doc", "mark", "hit_words", "names")
    per = stage(per, "contaminated")
    shown = lambda row, text: (row, F.size(item_words(text)).cast("long").alias("n_words"))
    if counted_bytes(per, 4 * F.size("hit_words") + F.coalesce(F.length(F.array_join("names", "  ")), F.lit(0))) <= common.BROADCAST_BYTES:
        per = F.broadcast(per)
        found = rows.join(per, same(rows, per), "left").select(*shown(rows.row, rows.text), "hit_words", "names")
    else:  # rows without hits are not shuffled
        hit, clean = rows.join(marks, "mark", "left_semi"), rows.join(marks, "mark", "left_anti")
        found = hit.join(per, same(hit, per), "left").select(*shown(hit.row, hit.text), "hit_words", "names")
        found = found.unionByName(clean.select(*shown(clean.row, clean.text)), allowMissingColumns=True)
    found = found.select("row", "n_words", F.coalesce("hit_words", F.expr("cast(array() as array<int>)")).alias("hit_words"), F.coalesce("names", F.expr("cast(array() as array<string>)")).alias("items"))
    return found.withColumn("n_hit", F.size("hit_words").cast("long")).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones; columns as given."""
    return unpacked(_contaminated(docs, benchmark, window).where("not contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit words, and the gaps before them, cut out of text; null texts stay null. Columns as given."""
    found = _contaminated(docs, benchmark, window).withColumn("text", F.col("row.text"))
    found = found.withColumn("w", F.array_remove(F.split("text", GAP_AS_IS), "")).withColumn("gaps", F.split("text", WORD_AS_IS))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.when(F.array_contains("hit_words", i.cast("int")), "").otherwise(F.concat(F.get("gaps", i), F.get("w", i))))
    cut = F.concat(F.array_join(parts, ""), F.element_at("gaps", -1))
    found = found.withColumn("text", F.when(F.col("n_hit") > 0, cut).otherwise(F.col("text")))
    return found.select(*(F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
