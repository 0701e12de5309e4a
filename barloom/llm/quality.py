"""Rule bitmask ledger: every rule is evaluated once, its failure kept as a bit beside the measurements; policies are masks.

DataFrame functions only; a document's measurements come from its own row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, packed, unpacked, words

#: Rules as (name, SQL predicate over the measurements that holds when the rule fails); a rule's bit is its place. Append only.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("bullet_lines", "n_lines >= 5 and 10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "n_lines >= 5 and 10 * n_ellipsis_lines > 3 * n_lines"),
    ("many_words", "n_words > 1000000"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: Policies by version: which rules reject.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BITS["symbols"] | BITS["duplicate_lines"] | BITS["short_words"] | BITS["long_words"],
    "v3": (1 << len(RULES)) - 1,
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_bullet_lines", "n_ellipsis_lines"]


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included. Windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, places))

    return F.when(F.size(w) < 4, 0).otherwise(let(windows, covered)).cast("long")


def _measure(text: Column) -> Column:
    def of(t: Column) -> Column:
        def by_words(w: Column) -> Column:
            def by_lines(lines: Column) -> Column:
                return F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                    repeated_words(w).alias("n_repeat_words"),
                    F.size(lines).cast("long").alias("n_lines"),
                    F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_exclamations"),
                    F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
                    F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
                )

            return let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), by_lines)

        return let(words(t), by_words)

    return let(F.coalesce(text, F.lit("")), of)


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements (long) and failed (long): bit i is set if rule i fails.

    A null text counts as empty: no words, which fails few_words. Columns with the names of the results, in whatever case, are
    replaced. Rows that repeat are measured alike; an empty table gives an empty result.
    """
    measured = packed(docs, m=_measure(F.col("text"))).select("row", "m.*")
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return unpacked(measured.withColumn("failed", failed.cast("long")), *MEASURES, "failed")


def verdict(policy: str = "v3") -> Column:
    """True where the ledger's failures leave a document under the policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(led: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """(policy, rule, failing, sole, kept, kept_without): for each policy and rule, documents that fail the rule, that fail no
    other rule of the policy, that the policy keeps, and that it would keep without the rule. One aggregation of the bits; an
    empty ledger gives zeros."""
    policies = policies or POLICIES
    per = [(p, name, mask, BITS[name]) for p, mask in policies.items() for name, _ in RULES if mask & BITS[name]]
    one = [F.struct(F.lit(p).alias("policy"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, n, m, b in per]
    by_bits = led.groupBy("failed").count()  # at most 2 ** len(RULES) rows
    bits = lambda m: F.col("failed").bitwiseAND(m)
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("count")).otherwise(0)), F.lit(0)).cast("long")
    rows = by_bits.select("failed", "count", F.explode(F.array(*one)).alias("p")).select("failed", "count", "p.*")
    zero = led.sparkSession.range(1).select(F.lit(0).cast("long").alias("failed"), F.lit(0).cast("long").alias("count"), F.explode(F.array(*one)).alias("p")).select("failed", "count", "p.*")
    return rows.unionByName(zero).groupBy("policy", "rule", "mask", "bit").agg(
        n(bits(F.col("bit")) > 0).alias("failing"), n(bits(F.col("mask")) == F.col("bit")).alias("sole"), n(bits(F.col("mask")) == 0).alias("kept"),
        n(F.col("failed").bitwiseAND(F.col("mask")).bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    ).drop("mask", "bit")
