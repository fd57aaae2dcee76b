"""Dashboard numbers, cluster quality, growth and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callweave import constants as C
from callweave.functions import vec as V
from callweave.functions.text import first_text
from callweave.operators import relational as R
from callweave.session import cut

NO_STRINGS = "cast(array() as array<string>)"


def totals(calls: DataFrame, questions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Row counts of the three tables as one row."""
    tagged = [df.select(F.lit(name).alias("t")) for name, df in
              (("calls", calls), ("questions", questions), ("clusters", clusters))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return rows.agg(*[F.count_if(F.col("t") == n).alias(f"total_{n}") for n in ("calls", "questions", "clusters")])


def call_stats(calls: DataFrame, hits: DataFrame, utterances: DataFrame) -> DataFrame:
    """Total calls, mean utterance confidence in percent, share of calls with personal data."""
    flagged = R.flag_calls(calls, hits).agg(
        F.count("*").alias("total"),
        F.coalesce(F.avg(F.when(F.col("violation_count") > 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("flagged_percent"))
    confidence = utterances.agg(F.coalesce(F.avg("confidence") * 100, F.lit(75.0)).alias("avg_confidence"))
    mean = confidence.scalar()
    return flagged.select(
        "total", F.when(F.col("total") == 0, 75.0).otherwise(mean).alias("avg_confidence"), "flagged_percent")


def call_keywords(questions: DataFrame) -> DataFrame:
    """Per call: short texts of its surest questions, main intent and up to two further intents."""
    order = W.partitionBy("call_id").orderBy(F.desc("confidence"), F.asc("id"))
    best = questions.withColumn("rn", F.row_number().over(order)).where("rn <= 10")
    grouped = best.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(
        "rn", F.substring("normalized_text", 1, 50).alias("text"), "intent", "secondary_intents"))).alias("q"))
    votes = F.flatten(F.transform("q", lambda x: F.when(
        x["rn"] == 1, x["secondary_intents"]).otherwise(F.concat(F.array(x["intent"]), x["secondary_intents"]))))
    ranked = F.array_sort(F.transform(
        F.array_distinct("votes"),
        lambda v: F.struct((-F.size(F.filter("votes", lambda o: o == v))).alias("n"), v.alias("intent"))))
    return grouped.withColumn("votes", F.filter(votes, lambda v: v.isin(C.INTENTS))).select(
        "call_id",
        F.transform(F.slice("q", 1, 5), lambda x: x["text"]).alias("keywords"),
        F.col("q")[0]["intent"].alias("primary_intent"),
        F.transform(F.slice(ranked, 1, 2), lambda x: x["intent"]).alias("secondary_intents"))


def search_clusters(hits: DataFrame) -> DataFrame:
    """Search hits per cluster, best first; the commonest intent wins, earliest rank on ties."""
    intents = hits.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id", "intent").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("score").alias("best"),
        F.sum("score").alias("total"))
    return intents.groupBy("cluster_id").agg(
        F.sum("n").alias("hit_count"), F.max("best").alias("max_score"),
        (F.sum("total") / F.sum("n")).alias("avg_score"),
        F.min_by("intent", F.struct(-F.col("n"), F.col("first_rank"))).alias("top_intent"),
    ).orderBy(F.desc("max_score"))


def _histogram(examples: DataFrame, column: str, name: str) -> DataFrame:
    counted = examples.groupBy("cluster_id", column).agg(F.count("*").alias("n"))
    return counted.groupBy("cluster_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def cluster_detail(clusters, faqs, members, questions, n: int = 20) -> DataFrame:
    """Cluster record with its latest FAQ, ``n`` best examples and label maps over those examples."""
    examples = R.cluster_examples(members, questions, n)
    listed = examples.groupBy("cluster_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "question_id"))), lambda x: x["question_id"]).alias("examples"))
    latest = latest_faq(faqs).select("cluster_id", F.col("id").alias("faq_id"))
    return (
        clusters.withColumnRenamed("id", "cluster_id")
        .join(latest, "cluster_id", "left").join(listed, "cluster_id", "left")
        .join(_histogram(examples, "intent", "intents"), "cluster_id", "left")
        .join(_histogram(examples, "language", "languages"), "cluster_id", "left"))


def latest_faq(faqs: DataFrame) -> DataFrame:
    rest = [c for c in faqs.columns if c != "cluster_id"]
    best = faqs.groupBy("cluster_id").agg(
        F.max_by(F.struct(*rest), F.struct("version", "created_at", "id")).alias("f"))
    return best.select("cluster_id", *[F.col(f"f.{c}").alias(c) for c in rest])


def cluster_dominants(members: DataFrame, questions: DataFrame, intents: int = 3) -> DataFrame:
    """Commonest language and the ``intents`` commonest intents per cluster."""
    joined = R.questions_with_cluster(questions, members).where(F.col("cluster_id").isNotNull())

    def ranked(column: str) -> DataFrame:
        counted = joined.where(F.col(column).isNotNull()).groupBy("cluster_id", column).agg(F.count("*").alias("n"))
        return counted.groupBy("cluster_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))),
            lambda x: x["v"]).alias(column))

    return ranked("language").join(ranked("intent"), "cluster_id", "full").select(
        "cluster_id", F.col("language")[0].alias("dominant_language"),
        F.slice("intent", 1, intents).alias("dominant_intents"))


def recount(clusters: DataFrame, members: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Cluster table with frequency set to the member count (0 when empty)."""
    counts = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n"))
    joined = clusters.join(counts, "id", "left")
    fresh = F.coalesce("n", F.lit(0).cast("bigint"))
    if touched is not None:
        joined = joined.join(touched.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
        fresh = F.when(F.col("hit"), fresh).otherwise(F.col("frequency"))
    return joined.withColumn("frequency", fresh).select(*clusters.columns)


def label_spread(members: DataFrame, questions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Size, purity and normalised entropy of intents per cluster, empty clusters included."""
    side = questions.select(F.col("id").alias("question_id"), "intent")
    counted = members.join(side, "question_id").where(F.col("intent").isNotNull()).groupBy("cluster_id", "intent").agg(
        F.count("*").alias("n"))
    n, total = F.col("n"), F.col("total")
    spread = counted.groupBy("cluster_id").agg(
        F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("kinds"),
        F.sum(n * F.log2(n)).alias("weighted"))
    entropy = (F.log2(total) - F.col("weighted") / total) / F.log2("kinds")
    sized = spread.select(
        "cluster_id", total.alias("size"), (F.col("top") / total).alias("purity"),
        F.when(F.col("kinds") <= 1, 0.0).otherwise(entropy).alias("entropy"))
    return clusters.select(F.col("id").alias("cluster_id")).join(sized, "cluster_id", "left").select(
        "cluster_id", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.coalesce("purity", F.lit(1.0)).alias("purity"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def ranked_values(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Per distinct value (nulls left out) the ranks it holds in its group: by, value, first, last, total.

    Exact order statistics are then a filter (``first <= rank and rank <= last``).  Equal values are counted before the shuffle, the
    counts are dealt out by range of (group, value), and a group's ranges are summed over one row a range, so no
    buffer or task holds the values of a group.
    """
    group = F.lit(0) if by is None else F.col(by)
    counts = values.where(F.col(column).isNotNull()).groupBy(group.alias("by"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counts.repartitionByRange("by", "value").withColumn("range", F.spark_partition_id()), "values")
    ranges = dealt.groupBy("by", "range").agg(F.sum("n").alias("held"))
    before = W.partitionBy("by").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("by", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
                           F.sum("held").over(W.partitionBy("by")).alias("total"))
    upto = W.partitionBy("by", "range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    last = F.col("before") + F.sum("n").over(upto)
    joined = dealt.alias("d").join(ranges.alias("r"), F.col("d.by").eqNullSafe(F.col("r.by")) & (F.col("d.range") == F.col("r.range"))).select(
        "d.by", "d.range", "value", "n", "before", "total")
    return joined.select("by", "value", (last - F.col("n") + 1).alias("first"), last.alias("last"), "total")


def size_stats(sizes: DataFrame) -> DataFrame:
    """count, min, max, mean (2 digits), median and nearest-rank p90 of ``size``."""
    zero = F.lit(0).cast("bigint")
    ranked = ranked_values(sizes, "size")
    holds = lambda rank: (F.col("first") <= rank) & (rank <= F.col("last"))
    total = F.col("total")
    low, high, p90 = (F.floor((total + 1) / 2), F.floor(total / 2) + 1, F.ceil(total * 9 / 10))
    at = lambda rank: F.max(F.when(holds(rank), F.col("value")))
    held = F.col("last") - F.col("first") + 1
    return ranked.agg(
        F.coalesce(F.sum(held), zero).alias("count"), F.coalesce(F.min("value"), zero).alias("min"),
        F.coalesce(F.max("value"), zero).alias("max"),
        F.coalesce(F.round(F.sum(F.col("value") * held) / F.sum(held), 2), F.lit(0.0)).alias("mean"),
        F.coalesce((at(low) + at(high)) / 2, F.lit(0.0)).alias("median"),
        F.coalesce(at(p90).cast("bigint"), zero).alias("p90"))


def dispersion(members: DataFrame, embeddings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean cosine distance of members to their centroid."""
    joined = members.select("question_id", "cluster_id").join(
        embeddings.select("question_id", "vector"), "question_id").join(
        clusters.select(F.col("id").alias("cluster_id"), "centroid"), "cluster_id")
    length = V.norm(F.col("vector"))
    similarity = V.dot(F.col("vector"), F.col("centroid")) / (
        F.when(length == 0, 1.0).otherwise(length) * V.norm(F.col("centroid")))
    distance = F.when(V.norm(F.col("centroid")) == 0, 0.0).otherwise(
        1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity)))
    return joined.select("cluster_id", distance.alias("d")).groupBy("cluster_id").agg(F.avg("d").alias("dispersion"))


def cluster_findings(clusters, members, questions, embeddings, glosses: int = 5) -> DataFrame:
    """One diagnostics row per cluster: size, purity, entropy, dispersion and sample glosses."""
    side = questions.select(F.col("id").alias("question_id"),
                            F.substring(first_text(F.col("english_gloss"), F.col("normalized_text")), 1, 120).alias("gloss"))
    order = W.partitionBy("cluster_id").orderBy("question_id")
    samples = (
        members.select("cluster_id", "question_id").join(side, "question_id")
        .withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= glosses)
        .groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "gloss"))), lambda x: x["gloss"]).alias("sample_glosses")))
    return (
        clusters.select(F.col("id").alias("cluster_id"), "label", "frequency")
        .join(label_spread(members, questions, clusters), "cluster_id")
        .join(dispersion(members, embeddings, clusters), "cluster_id", "left")
        .join(samples, "cluster_id", "left")
        .select("cluster_id", "label", "frequency", "size", F.round("purity", 3).alias("intent_purity"), "purity",
                F.round("entropy", 3).alias("intent_entropy"), F.round("dispersion", 3).alias("dispersion"),
                F.coalesce("sample_glosses", F.expr(NO_STRINGS)).alias("sample_glosses")))


def coarse_clusters(findings: DataFrame, size: int = 10, purity: float = 0.6) -> DataFrame:
    """Clusters that are both large and mixed, largest first."""
    return findings.where((F.col("size") >= size) & (F.col("purity") < purity)).orderBy(F.desc("size"), "cluster_id")


def drift(members: DataFrame, clusters: DataFrame, as_of: str, days: int = 7, least: int = 3, limit: int = 20) -> DataFrame:
    """Clusters growing fast relative to their size before the window."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    grown = members.groupBy("cluster_id").agg(
        F.min("assigned_at").alias("first_seen"), F.count("*").alias("current_size"),
        F.count_if(F.col("assigned_at") >= since).alias("recent_size")).where(F.col("recent_size") >= least)
    baseline = F.greatest(F.lit(0).cast("bigint"), F.col("current_size") - F.col("recent_size"))
    rate = F.when(F.col("recent_size") <= 0, 0.0).when(
        F.col("baseline_size") <= 0, F.col("recent_size").cast("double")).otherwise(F.col("recent_size") / F.col("baseline_size"))
    return (
        grown.withColumn("baseline_size", baseline).withColumn("growth_rate", rate)
        .join(clusters.select(F.col("id").alias("cluster_id"), "label"), "cluster_id", "left")
        .orderBy(F.desc("growth_rate"), F.desc("recent_size"), "cluster_id").limit(limit))


def stage_histogram(events: DataFrame) -> DataFrame:
    """Cumulative duration histogram per stage and the p95 read from it against its limit.

    All buckets are counted in one pass (no row multiplication); the quantile is
    interpolated inside its bucket, so no list of durations is ever held.
    """
    bounds = C.STAGE_BUCKETS
    wide = events.groupBy("stage").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("duration") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rank = F.col("total") * 0.95
    p95 = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        below = F.col(f"b{i - 1}") if i else F.lit(0)
        low = bounds[i - 1] if i else 0.0
        inside = F.col(f"b{i}") - below
        value = F.lit(low) + F.lit(bounds[i] - low) * (rank - below) / F.nullif(inside, F.lit(0))
        p95 = F.when(F.col(f"b{i}") >= rank, value).otherwise(p95)
    limit = F.lit(None).cast("double")
    for stage, seconds in C.STAGE_SLO_SECONDS.items():
        limit = F.when(F.col("stage") == stage, F.lit(seconds)).otherwise(limit)
    buckets = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return wide.select("stage", "total", p95.alias("p95"), (p95 < limit).alias("within_slo"), F.inline(buckets))


def waveform(utterances: DataFrame, bars: int = C.WAVEFORM_BARS) -> DataFrame:
    """Bar heights per call, 1 for empty bars."""
    spans = R.call_spans(utterances)
    filled = R.bars_touched(utterances, spans, bars).groupBy("call_id", "bar").agg(
        F.avg("confidence").alias("conf"), F.count("*").alias("n"))
    spine = spans.select("call_id", F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bar"))
    height = F.least(F.lit(30), F.greatest(F.lit(1), F.floor(1 + F.col("conf") * 15 + F.col("n") * 3)))
    return spine.join(filled, ["call_id", "bar"], "left").select(
        "call_id", F.col("bar").cast("bigint").alias("bar"), F.coalesce(height, F.lit(1)).cast("bigint").alias("height"))


def reextract_plan(calls: DataFrame, questions: DataFrame, statuses: list[str]) -> DataFrame:
    """Dry run: how many calls, questions and gold questions a re-extraction would touch."""
    picked = calls.where(F.col("status").isin(statuses)).select(F.col("id").alias("call_id"))
    owned = questions.join(picked, "call_id", "left_semi").agg(
        F.count("*").alias("n_questions"), F.count_if("human_override").alias("n_gold"))
    n = picked.agg(F.count("*").alias("n_calls")).scalar()
    return owned.select(n.alias("n_calls"), "n_questions", "n_gold")
