"""Typed knowledge graph of calls: nodes, edges, merging, related rows and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave import constants as C
from callweave.functions.clean import clamp_unit, clean_na, map_literal, normalize_product
from callweave.functions.numbers import compact_weight
from callweave.functions.text import slug
from callweave.session import cut

NODE_ATTRIBUTES = ["escalation", "call_date", "phone_mismatch", "phone", "lead_nos", "matched"]
NODE_TYPE = "array<struct<id:string,type:string,label:string,attrs:map<string,string>>>"
EDGE_TYPE = ("array<struct<src_id:string,src_type:string,dst_id:string,dst_type:string,relation:string,"
             "weight:double,reason:string>>")
NO_STRINGS = "cast(array() as array<string>)"
NEEDED = ["call_id", "call_date", "escalation", "phone_mismatch", "join_phone", "lead_nos", "product_interest", "products", "full_name",
          "disposition", "disposition_confidence", "disposition_rationale", "sentiment", "sentiment_confidence", "has_cdr", "agent_id", "campaign"]
TASK_ROWS = 1 << 19  # lines of notes that a task sorts
HUB_SHARE = 1e-3  # share of all lines from which a note is dealt to several tasks


def node_id(kind: str, raw: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), raw)


def tasks(df: DataFrame) -> int:
    """As many tasks as the session shuffles to.

    For steps that make many wide rows of each: the adaptive planner and file scans pack tasks by the size of what goes in, so that what
    they sort would grow up to a task's whole memory; a number that is asked for is left alone.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _facts(calls: DataFrame) -> DataFrame:
    """Cleaned per-call facts both graph halves are built from."""
    interest = normalize_product(F.col("product_interest"))
    # Dealt by a hash of the id: by the id itself they may lie already, in tasks packed by size.
    return calls.select(*NEEDED).repartition(tasks(calls), F.xxhash64("call_id")).select(
        "call_id", "call_date", F.coalesce("escalation", F.lit(False)).alias("escalation"),
        "phone_mismatch", "join_phone", "lead_nos",
        F.array_distinct(F.array_compact(F.concat(F.array(interest), F.coalesce("products", F.expr(NO_STRINGS))))).alias("products"),
        clean_na(F.col("full_name")).alias("full_name"),
        clean_na(F.col("disposition")).alias("disposition"), "disposition_confidence",
        clean_na(F.col("disposition_rationale")).alias("rationale"),
        clean_na(F.col("sentiment")).alias("sentiment"), "sentiment_confidence",
        F.when(F.col("has_cdr"), clean_na(F.col("agent_id"))).alias("agent"),
        F.when(F.col("has_cdr"), clean_na(F.col("campaign"))).alias("campaign"))


def call_nodes(calls: DataFrame) -> DataFrame:
    """Node occurrences of every call in one pass (a call row explodes to its nodes)."""
    none = F.lit(None).cast("map<string,string>")

    def node(kind: str, raw: Column, label: Column, attrs: Column = none) -> Column:
        return F.when(raw.isNotNull(), F.struct(node_id(kind, raw).alias("id"), F.lit(kind).alias("type"),
                                                label.alias("label"), attrs.alias("attrs")))

    def attributes(**values: Column) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])

    single = F.array(
        node("call", F.col("call_id"), F.concat(F.lit("Call "), F.col("call_id")), attributes(
            escalation=F.col("escalation"), call_date=F.col("call_date"),
            phone_mismatch=F.when(F.col("phone_mismatch"), F.lit("true")))),
        node("lead", F.col("join_phone"), F.coalesce("full_name", "join_phone"), attributes(
            phone=F.col("join_phone"), lead_nos=F.array_join("lead_nos", ", "), matched=F.size("lead_nos") > 0)),
        node("disposition", F.col("disposition"), F.col("disposition")),
        node("sentiment", F.col("sentiment"), F.col("sentiment")),
        node("agent", F.col("agent"), F.col("agent")),
        node("campaign", F.col("campaign"), F.col("campaign"))).cast(NODE_TYPE)
    products = F.transform("products", lambda p: F.struct(
        node_id("product", p).alias("id"), F.lit("product").alias("type"), p.alias("label"), none.alias("attrs"))).cast(NODE_TYPE)
    return _facts(calls).select(F.col("call_id").alias("seq"), F.inline(F.array_compact(F.concat(single, products))))


def call_edges(calls: DataFrame) -> DataFrame:
    """Edge occurrences of every call in one pass."""

    def edge(src: str, src_raw: Column, dst: str, dst_raw: Column, relation: str,
             weight: Column | None = None, reason: Column | None = None) -> Column:
        return F.when(src_raw.isNotNull() & dst_raw.isNotNull(), F.struct(
            node_id(src, src_raw).alias("src_id"), F.lit(src).alias("src_type"),
            node_id(dst, dst_raw).alias("dst_id"), F.lit(dst).alias("dst_type"), F.lit(relation).alias("relation"),
            (F.lit(1.0) if weight is None else weight).alias("weight"),
            (F.lit(None).cast("string") if reason is None else reason).alias("reason")))

    call, lead = F.col("call_id"), F.col("join_phone")
    single = F.array(
        edge("lead", lead, "call", call, "received_call"),
        edge("call", call, "disposition", F.col("disposition"), "has_disposition",
             clamp_unit(F.col("disposition_confidence")), F.col("rationale")),
        edge("call", call, "sentiment", F.col("sentiment"), "has_sentiment", clamp_unit(F.col("sentiment_confidence"))),
        edge("call", call, "agent", F.col("agent"), "handled_by"),
        edge("lead", lead, "campaign", F.col("campaign"), "in_campaign")).cast(EDGE_TYPE)
    about = F.transform("products", lambda p: edge("call", call, "product", p, "about_product")).cast(EDGE_TYPE)
    interested = F.transform("products", lambda p: edge("lead", lead, "product", p, "interested_in")).cast(EDGE_TYPE)
    return _facts(calls).select(F.col("call_id").alias("seq"), F.inline(F.array_compact(F.concat(single, about, interested))))


def merge_nodes(nodes: DataFrame, attributes=tuple(NODE_ATTRIBUTES)) -> DataFrame:
    """One row per node id: first non-empty label, later non-null attribute values win.

    Popular nodes (a sentiment, an agent) occur in a large share of all calls;
    every part here combines map-side, so they cost one row per task.
    """
    value = {a: F.try_element_at("attrs", F.lit(a)) for a in attributes}
    merged = nodes.groupBy("id").agg(
        F.min_by("type", "seq").alias("type"),
        F.coalesce(F.min_by("label", F.when(F.col("label") != "", F.col("seq"))), F.lit("")).alias("label"),
        *[F.max_by(v, F.when(v.isNotNull(), F.col("seq"))).alias(f"a_{a}") for a, v in value.items()])
    attrs = F.map_filter(F.create_map(*[x for a in attributes for x in (F.lit(a), F.col(f"a_{a}"))]), lambda k, v: v.isNotNull())
    return merged.select("id", "type", "label", attrs.alias("attrs"))


def merge_edges_by_weight(edges: DataFrame, keys=("src_id", "dst_id", "relation")) -> DataFrame:
    """One row per edge key: the greatest weight with its reason, the first seen on ties."""
    rest = [c for c in edges.columns if c not in keys and c != "seq"]
    best = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col("weight"), F.col("seq"))).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def attribute_text(attrs: Column) -> Column:
    """Attributes as 'key=value' pairs in key order."""
    pairs = F.transform(F.array_sort(F.map_keys(attrs)), lambda k: F.concat(k, F.lit("="), F.element_at(attrs, k)))
    return F.array_join(pairs, ";")


def note_name(kind: Column, ident: Column) -> Column:
    return F.concat(slug(kind), F.lit("-"), slug(ident))


def note_names(nodes: DataFrame) -> DataFrame:
    """Unique note name per node: a later id whose slug is taken gets a digest suffix.

    Both sides grow with the nodes, and are guessed small where they come from a compressed table, so they are never broadcast.
    """
    based = nodes.select("id", "type", note_name(F.col("type"), F.col("id")).alias("base"))
    owners = based.groupBy("base").agg(F.min("id").alias("owner"))
    digest = F.substring(F.sha1(F.concat(F.col("type"), F.lit("|"), F.col("id"))), 1, 6)
    return based.join(owners.hint("merge"), "base").select("id", "type", F.when(
        F.col("id") == F.col("owner"), F.col("base")).otherwise(F.concat("base", F.lit("-"), digest)).alias("name"))


def related(edges: DataFrame) -> DataFrame:
    """Rows of each node's Related table: both directions, self loops once.

    ``seq`` orders edges; the first edge wins among equal (relation, other, direction).
    """
    # Merged edges hardly ever agree in all four, so sorting them for partial sums before the shuffle gains nothing.
    keys = ["node_id", "relation", "other", "direction"]
    return _first_edges(_both_ends(edges).repartition(tasks(edges), *keys), keys).select(
        "node_id", "direction", "relation", "other", "weight", "reason")


def _first_edges(ends: DataFrame, keys: list[str]) -> DataFrame:
    return ends.groupBy(*keys).agg(F.min_by(F.struct("weight", "reason"), "seq").alias("b")).select(*keys, "b.weight", "b.reason")


def _both_ends(edges: DataFrame) -> DataFrame:
    """Every edge as seen from its ends, self loops once: (relation, weight, reason, node_id, seq, other, direction).

    ``seq`` is the id of the other end: as the node is the same among rows that agree, it orders them as both ids would.
    """
    weight = compact_weight(F.col("weight"))
    reason = F.coalesce("reason", F.lit(""))
    # Names and weights are columns of the edge, so that the two rows of an edge don't make them anew.
    named = edges.select("src_id", "dst_id", "relation", weight.alias("weight"), reason.alias("reason"), note_name(F.col("src_type"), F.col("src_id")).alias(
        "src_name"), note_name(F.col("dst_type"), F.col("dst_id")).alias("dst_name"))

    def end(node: str, far: str, direction: str) -> Column:
        return F.struct(F.col(f"{node}_id").alias("node_id"), F.col(f"{far}_id").alias("seq"), F.col(f"{far}_name").alias("other"), F.lit(direction).alias("direction"))

    ends = F.array(end("src", "dst", "out"), end("dst", "src", "in"))
    return named.select("relation", "weight", "reason",
                        F.inline(F.when(F.col("src_id") == F.col("dst_id"), F.slice(ends, 1, 1)).otherwise(ends)))


def _escape(c: Column) -> Column:
    step = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(step, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Markdown notes line by line: (id, folder, name, section, line, text), in the order (section, line) within a note.

    Section 0 is the head of the note, section 1 its Related table.  Rows of the table are ordered by direction, relation,
    other end, weight and reason; ``line`` is that order as text, so a hub node needs no sort of its own and no cell that grows with it.

    Rows of the table are shuffled once, narrow, to the row of their node: the same partitions serve for the first of equal rows and
    for the names, and the text is made behind them.  A node with a large share of all rows is dealt to several partitions, by what equal rows agree in.
    """
    edges = cut(edges, "edges")
    cell = F.concat(F.lit("| "), _escape(F.col("relation")), F.lit(" | [["), F.col("other"), F.lit("]] | "),
                    _escape(F.col("weight")), F.lit(" | "), _escape(F.col("reason")), F.lit(" |"))
    place = F.concat_ws("\u0001", "direction", "relation", "other", "weight", "reason")
    folder = F.coalesce(F.try_element_at(map_literal(C.NOTE_FOLDERS), F.col("type")), F.lit("misc"))
    nodes = cut(nodes.select("id", "type", "label"), "nodes")
    named = cut(nodes.join(note_names(nodes).select("id", "name").hint("merge"), "id").select("id", folder.alias("folder"), "name", "label"), "named")
    head = F.array(F.concat(F.lit("# "), F.col("label")), F.lit(""), F.lit("## Related"), F.lit(""), F.lit("| Relation | Linked Note | Weight | Reason |"),
                   F.lit("| --- | --- | --- | --- |"))
    top = named.select("id", "folder", "name", F.lit(0).alias("section"), F.posexplode(head).alias("line", "text")).withColumn("line", F.col("line").cast("string"))
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("id"))
    hubs = ends.stat.freqItems(["id"], HUB_SHARE).first()[0]  # all that have the share, and no more than 1 / HUB_SHARE in all
    to = max(tasks(edges), -(-2 * edges.count() // TASK_ROWS))
    keys = ["id", "part", "relation", "other", "direction"]
    hub = F.col("id").isin(hubs)
    rows = _both_ends(edges).withColumnRenamed("node_id", "id").withColumn(
        "part", F.when(hub, F.pmod(F.xxhash64("relation", "other", "direction"), F.lit(to))).otherwise(0).cast("int"))
    owners = named.select("id", "folder", "name", F.explode(F.sequence(F.lit(0), F.when(hub, to - 1).otherwise(0))).alias("part"))
    table = _first_edges(rows.repartition(to, "id", "part"), keys).join(owners.repartition(to, "id", "part").hint("merge"), ["id", "part"])
    return top.unionByName(table.select("id", "folder", "name", F.lit(1).alias("section"), place.alias("line"), cell.alias("text")))
