"""Licence scan by canonical digest look-up.

A text is brought to a canonical form (lower case, copyright lines gone, punctuation and space folded to one blank, equal
spellings made one), hashed with SHA-256 and joined to the digests of known licence texts.  The whole text must be the licence; a
licence inside other prose is no match.  Lines are looked up in the same way, each as a whole, for one-line notices.

The known texts are constants of this library, so the joined table and the line table have a fixed size.  Nothing is shuffled.

Null text counts as empty, and empty canonical forms match nothing.  Rows are judged one by one: repeated rows, ties and null
ids need no rule.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.license_texts import COPYRIGHT_LINE, EQUAL_PHRASES, EQUAL_WORDS, NAMES, NOT_A_WORD, OPENINGS, TEXTS


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), NOT_A_WORD, " ")
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    return F.trim(reduce(lambda x, pair: F.replace(x, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), EQUAL_WORDS + EQUAL_PHRASES, padded))


def canonical_sql(text: str) -> str:
    """The same form as DuckDB SQL."""
    plain = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g'), '{NOT_A_WORD}', ' ', 'g')"
    return f"trim({reduce(lambda x, p: f"replace({x}, ' {p[0]} ', ' {p[1]} ')", EQUAL_WORDS + EQUAL_PHRASES, f"' ' || {plain} || ' '")}, ' ')"


def notices() -> list[tuple[str, str]]:
    return [(name, start + form) for name, forms in NAMES.items() for form in forms for start in OPENINGS]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, license), one row per digest."""
    pairs = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts])
    rows = spark.range(1).select(F.inline(pairs))
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license").alias("license"))


def scanned(docs: DataFrame) -> DataFrame:
    """Per document: canonical_sha256, license (of the whole text, or null), notices (licences named by its lines), n_notices (such lines)."""
    spark = docs.sparkSession
    lines = known_digests(spark, notices()).collect()  # constants: one row per opening and name at most
    named = F.create_map(*[F.lit(x) for row in lines for x in (row.digest, row.license)])
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", F.sha2(canonical(text), 256).alias("canonical_sha256"),
                       F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0).alias("_lines"))
    step = step.select("doc_id", "canonical_sha256", F.transform("_lines", lambda x: F.sha2(canonical(x), 256)).alias("_digests"))
    step = step.select("doc_id", "canonical_sha256", F.filter(F.transform("_digests", lambda d: F.element_at(named, d)), lambda x: x.isNotNull()).alias("_found"))
    whole = known_digests(spark, TEXTS).withColumnRenamed("digest", "canonical_sha256")
    return step.join(F.broadcast(whole), "canonical_sha256", "left").select(
        "doc_id", "canonical_sha256", "license", F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"),
        F.size("_found").cast("long").alias("n_notices"))
