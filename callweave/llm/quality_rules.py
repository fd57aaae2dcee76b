"""Quality rules as a bitmask ledger.

``ledger`` measures each text once and stores, beside the measurements, one bit per failed rule.  Policies are sets of rules
with a version; a verdict under any policy, and what each rule contributes to it, then come from the stored bits alone,
without reading a text again.  Everything is a DataFrame expression; nothing is shuffled but the bit patterns of an ablation.

Null text counts as empty.  Rows are judged one by one, so repeated rows, ties and null ids need no rule, and an empty table
gives an empty ledger.  Only ``doc_id`` and ``text`` are read.  Other columns can be carried along by name; where their names may be
those of measurements, carry the row as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[^#*$%&|<>]+"

# Order fixes the bits; append only.
RULES = {
    "too_few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
}
BASE = ["too_few_words", "repeated_words"]
POLICIES = {
    1: BASE,
    2: [*BASE, "symbols", "repeated_lines"],
    3: list(RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def mask(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in rules)


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the measurements of ``text``; each array is built once, in a projection of its own."""
    keep = ["doc_id"] if keep is None else keep
    step = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    step = step.select(*keep, "_text", F.array_remove(F.split("_text", SPACE), "").alias("_words"),
                       F.filter(F.split("_text", "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0).alias("_lines"))
    word = F.col("_words")
    grams = F.transform(F.sequence(F.lit(0), F.size(word) - 3),
                        lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))
    step = step.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(word) >= 3, grams).otherwise(F.expr("cast(array() as array<bigint>)")).alias("_grams"))
    kept = [*keep, *MEASURES[:-1]]
    # Most texts repeat no window: only the others are sorted.
    placed = F.sort_array(F.transform("_grams", lambda gram, i: F.struct(gram.alias("gram"), i.alias("at"))))
    step = step.select(*kept, F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), placed).alias("_placed"))
    at = F.col("_placed")

    def met(window: Column, i: Column) -> Column:
        gram = window["gram"]
        return F.coalesce(F.get(at, i - 1)["gram"] == gram, F.lit(False)) | F.coalesce(F.get(at, i + 1)["gram"] == gram, F.lit(False))

    step = step.select(*kept, F.filter(at, met).alias("_met"))
    covered = F.array_distinct(F.flatten(F.transform("_met", lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2))))
    return step.select(*kept, F.when(F.col("_met").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Measurements and ``fail_bits``: bit k is set where the k-th rule fails."""
    found = measured(docs, keep)
    bits = None
    for k, rule in enumerate(RULES.values()):
        bit = F.when(rule({m: F.col(m) for m in MEASURES}), F.lit(1 << k)).otherwise(0).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return found.withColumn("fail_bits", bits)


def passes(bits: Column, version: int) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def ablation(book: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that fail nothing else of the policy (what dropping it would free)."""
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[version]])
    each = patterns.select("bits", "count", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"))
