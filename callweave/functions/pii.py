"""Personal-data hits in text: positions, overlap removal and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions.vec import let

HIT_TYPE = "array<struct<start:int,stop:int,rank:int,type:string,value:string>>"


# What a numeric hit starts with.  Looking at one character first lets the scan
# skip most positions before the costly word-boundary test.
FIRST_CHARACTER = {"SSN": r"(?=\p{Nd})", "PHONE": r"(?=[(\p{Nd}])", "AADHAR": r"(?=\p{Nd})"}


def wide_pattern(pattern: str) -> str:
    """Digits and blanks of every script, as the patterns are meant."""
    return pattern.replace(r"\d", r"\p{Nd}").replace(r"[-.\s]", r"[-.\s\p{Z}]")


def _positions(text: Column, kind: str) -> Column:
    """Hits of one kind in text order.

    A start offset is the length of everything before it: the pieces between
    hits (``split``) and the hits themselves run in step.  Texts without a hit of
    this kind are not split.
    """
    pattern = wide_pattern(C.PII_PATTERNS[kind]).replace("]+@", "]++@")  # the name part never gives back
    if kind in FIRST_CHARACTER:
        pattern = f"{FIRST_CHARACTER[kind]}(?:{pattern})"
    rank = list(C.PII_PATTERNS).index(kind)
    none = F.expr(f"cast(array() as {HIT_TYPE})")
    start = F.struct(F.lit(0).alias("pos"), none.alias("hits"))

    def step(acc, pair):
        begin = acc["pos"] + pair["gap"]
        stop = begin + F.length(pair["value"])
        hit = F.struct(begin.alias("start"), stop.alias("stop"), F.lit(rank).alias("rank"),
                       F.lit(kind).alias("type"), pair["value"].alias("value"))
        return F.struct(stop.alias("pos"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    def located(values):
        pairs = F.zip_with(F.split(text, pattern, -1), values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
        found = F.filter(pairs, lambda p: p["value"].isNotNull())
        return F.when(F.size(values) == 0, none).otherwise(F.aggregate(found, start, step)["hits"])

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
    # No address without its sign: a plain substring test spares most texts the pattern.
    return F.when(F.contains(text, F.lit("@")), hits).otherwise(none) if kind == "EMAIL" else hits


def all_hits(text: Column) -> Column:
    """Every hit of every kind (before overlap removal), ordered by position.

    A phone hit is skipped when its start or its end lies inside an SSN hit.
    """

    def with_ssn(ssn):
        inside = lambda p: F.exists(ssn, lambda s: (
            (s["start"] <= p["start"]) & (p["start"] < s["stop"])) | ((s["start"] < p["stop"]) & (p["stop"] <= s["stop"])))
        phone = F.filter(_positions(text, "PHONE"), lambda p: ~inside(p))
        return F.array_sort(F.concat(ssn, phone, *[_positions(text, k) for k in ("EMAIL", "AADHAR", "PAN")]))

    # Every kind needs a digit or an @: one cheap scan spares other texts all patterns.
    none = F.expr(f"cast(array() as {HIT_TYPE})")
    return F.when(text.rlike(r"[\p{Nd}@]"), let(_positions(text, "SSN"), with_ssn)).when(text.isNotNull(), none)


def keep_disjoint(hits: Column) -> Column:
    """Greedy left-to-right choice of hits that do not overlap an earlier kept one."""
    start = F.struct(F.lit(-1).alias("last"), F.expr(f"cast(array() as {HIT_TYPE})").alias("kept"))
    return F.aggregate(
        hits, start,
        lambda acc, h: F.when(
            h["start"] >= acc["last"],
            F.struct(h["stop"].alias("last"), F.concat(acc["kept"], F.array(h)).alias("kept")),
        ).otherwise(acc))["kept"]


def replacement(kind: Column, value: Column, method: str = "mask") -> Column:
    if method == "remove":
        return F.lit("")
    tail = F.substring(value, -4, 4)
    return (
        F.when(kind == "SSN", F.concat(F.lit("***-**-"), tail))
        .when(kind == "PHONE", F.concat(F.lit("***-***-"), tail))
        .when(kind == "EMAIL", F.concat(F.substring(value, 1, 1), F.lit("***@"), F.substring_index(value, "@", -1)))
        .when(kind == "AADHAR", F.concat(F.lit("****-****-"), tail))
        .otherwise(F.concat(F.substring(value, 1, 2), F.lit("***"), F.substring(value, -2, 2)))
    )


def redact(text: Column, kept: Column, method: str = "mask") -> Column:
    """Text with the kept hits replaced."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    folded = F.aggregate(
        kept, start,
        lambda acc, h: F.struct(
            F.concat(acc["out"], F.substr(text, acc["pos"] + 1, h["start"] - acc["pos"]),
                     replacement(h["type"], h["value"], method)).alias("out"),
            h["stop"].alias("pos")))
    return F.concat(folded["out"], F.substr(text, folded["pos"] + 1))
