"""Input views over the driver tables.

Every query of the catalog starts from a view such as ``v_utterances``.  A view
is one SQL text with a handful of dialect-specific pieces, so the same
definition feeds Spark (temporary views) and the DuckDB check (``WITH`` list).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from callweave import constants as C

AS_OF = "2024-01-31 00:00:00"


class Dialect:
    """The few spellings that differ between the two engines."""

    name = ""

    def pick(self, index: str, values: list) -> str:
        raise NotImplementedError

    @staticmethod
    def lit(value) -> str:
        return "cast(null as string)" if value is None else "'" + str(value).replace("'", "''") + "'"


class SparkDialect(Dialect):
    name = "spark"
    as_of = f"timestamp_ntz'{AS_OF}'"
    idiv = "div"

    def pick(self, index, values):
        return f"element_at(array({', '.join(map(self.lit, values))}), cast(({index}) + 1 as int))"

    def strings(self, *exprs):
        return f"array({', '.join(exprs)})"

    empty_strings = "cast(array() as array<string>)"

    def days(self, n):
        return f"make_dt_interval(cast({n} as int))"

    def minutes(self, n):
        return f"make_dt_interval(0, 0, cast({n} as int))"

    def ts(self, text):
        return f"timestamp_ntz'{text}'"

    def fmt_date(self, expr):
        return f"date_format({expr}, 'yyyy-MM-dd')"

    def fmt_ts(self, expr, layout):
        patterns = {
            "iso": "yyyy-MM-dd HH:mm:ss", "isoT": "yyyy-MM-dd''T''HH:mm:ss", "date": "yyyy-MM-dd",
            "dmy-": "dd-MM-yyyy HH:mm:ss", "dmy/": "dd/MM/yyyy HH:mm:ss", "dmyd-": "dd-MM-yyyy",
            "dmyd/": "dd/MM/yyyy",
        }
        return f"date_format({expr}, '{patterns[layout]}')"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def json(self, expr):
        return f"to_json({expr}, map('ignoreNullFields', 'false'))"

    def list_of(self, expr, order, cond):
        return (f"transform(array_sort(collect_list(case when {cond} then "
                f"struct({order} as o, {expr} as e) end)), x -> x.e)")

    def min_by(self, value, key):
        return f"min_by({value}, {key})"

    def repeat(self, expr, n):
        return f"repeat({expr}, cast({n} as int))"

    def json_text(self, expr, key):
        return f"get_json_object({expr}, '$.{key}')"

    def concat_lists(self, a, b):
        return f"concat({a}, {b})"

    def sequence(self, lo, hi):
        return f"explode(sequence({lo}, {hi}))"


class DuckDialect(Dialect):
    name = "duckdb"
    as_of = f"timestamp '{AS_OF}'"
    idiv = "//"

    def pick(self, index, values):
        return f"([{', '.join(map(self.lit, values))}])[({index}) + 1]"

    def strings(self, *exprs):
        return f"[{', '.join(exprs)}]"

    empty_strings = "cast([] as varchar[])"

    def days(self, n):
        return f"to_days(cast({n} as int))"

    def minutes(self, n):
        return f"to_minutes({n})"

    def ts(self, text):
        return f"timestamp '{text}'"

    def fmt_date(self, expr):
        return f"strftime({expr}, '%Y-%m-%d')"

    def fmt_ts(self, expr, layout):
        patterns = {
            "iso": "%Y-%m-%d %H:%M:%S", "isoT": "%Y-%m-%dT%H:%M:%S", "date": "%Y-%m-%d",
            "dmy-": "%d-%m-%Y %H:%M:%S", "dmy/": "%d/%m/%Y %H:%M:%S", "dmyd-": "%d-%m-%Y",
            "dmyd/": "%d/%m/%Y",
        }
        return f"strftime({expr}, '{patterns[layout]}')"

    def struct(self, **fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def json(self, expr):
        return f"cast(to_json({expr}) as string)"

    def list_of(self, expr, order, cond):
        return f"coalesce(list({expr} order by {order}) filter (where {cond}), [])"

    def min_by(self, value, key):
        return f"arg_min({value}, {key})"

    def repeat(self, expr, n):
        return f"repeat({expr}, {n})"

    def json_text(self, expr, key):
        return f"json_extract_string({expr}, '$.{key}')"

    def concat_lists(self, a, b):
        return f"list_concat({a}, {b})"

    def sequence(self, lo, hi):
        return f"unnest(range({lo}, {hi} + 1))"


@dataclass(frozen=True)
class View:
    deps: tuple[str, ...]
    sql: Callable[[Dialect], str]


VIEWS: dict[str, View] = {}


def view(*deps: str):
    def register(fn):
        VIEWS[fn.__name__] = View(deps, fn)
        return fn

    return register


@view("conversations")
def v_utterances(d):
    return """
    select cast(conv_id as string) || '-' || cast(turn as string) as utterance_id,
           cast(conv_id as string) as call_id, turn as idx,
           case role when 'assistant' then 'AGENT' when 'user' then 'CUSTOMER' else 'UNKNOWN' end as speaker,
           case when conv_id % 4 = 0 then null when role = 'assistant' then '0'
                when role = 'user' then '1' end as speaker_id,
           turn * 10e0 as start_ts,
           turn * 10e0 + least(length(text), 180) / 20e0 as end_ts,
           case when turn = 0 and conv_id % 3 = 0 then 'hello ' else '' end || text
             || case when turn % 3 = 2 then ' how what?' else '' end as text,
           'en' as language, 5e-1 + (turn % 5) * 1e-1 as confidence
    from conversations"""


@view("v_utterances")
def v_turns(d):
    return """
    select call_id, start_ts + 3e0 as start, end_ts + 3e0 as stop,
           cast(idx % 2 as string) as speaker_id
    from v_utterances"""


@view("v_utterances")
def v_segments(d):
    return f"""
    select call_id, idx, start_ts as start, end_ts as stop,
           case when idx % 5 = 4 then '   ' else text end as text,
           case when idx % 7 = 6 then null else (idx % 4) * -3e-1 end as avg_logprob,
           {d.pick("idx % 5", ["hi-IN", "en-US", "ta", "xx", None])} as language_code
    from v_utterances"""


@view("v_segments")
def v_stt_payload(d):
    entry = d.struct(transcript="text", speaker_id="cast(idx % 2 as string)",
                     start_time_seconds="start", end_time_seconds="stop")
    pack = d.struct(language_code="language_code",
                    diarized_transcript=d.struct(entries="entries"), transcript="transcript")
    return f"""
    select call_id, duration_seconds, {d.json(pack)} as payload
    from (
      select call_id, max(stop) as duration_seconds,
             {d.pick("cast(call_id as bigint) % 3", ["hi-IN", "en-US", None])} as language_code,
             'flat transcript ' || call_id as transcript,
             {d.list_of(entry, "idx", "cast(call_id as bigint) % 5 <> 0")} as entries
      from v_segments group by call_id) g"""


@view("events")
def v_calls(d):
    return f"""
    select cast(event_id as string) as id, ts as created_at, ts as updated_at,
           'minio://calls/' || cast(event_id as string) || '.wav' as source_uri,
           {d.pick("event_id % 12", C.CALL_STATUSES)} as status, value as duration_seconds,
           case when value < 5 then '0-5s' when value < 15 then '5-15s'
                when value < 30 then '15-30s' else '30s+' end as bucket,
           '{{"agent_id":"AG' || cast(user_id % 20 as string) || '","customer_id":"C'
             || cast(user_id as string) || '","campaign":"' || event_type || '","channel":"'
             || case when event_id % 2 = 0 then 'inbound' else 'ivr' end || '","stt_provider":'
             || case when event_id % 2 = 0 then 'null' else '"whisper"' end
             || ',"extra":' || props || '}}' as metadata,
           case when event_id % 12 = 11 then 'worker lost' end as error_message
    from events"""


@view("events")
def v_stage_events(d):
    return f"""
    select cast(event_id as string) as event_id, cast(event_id % 500 as string) as call_id,
           case event_type when 'click' then 'stt' when 'view' then 'extract'
                when 'purchase' then 'embed' when 'error' then 'cluster' else 'canonicalize' end as stage,
           ts, value / 10e0 as duration,
           {d.pick("event_id % 12", C.CALL_STATUSES)} as status,
           case when event_type = 'error' then
             case when event_id % 2 = 0 then 'ConnectTimeout: upstream timed out'
                  else 'ValidationError: bad field' end end as error
    from events"""


@view("events")
def v_ingest_events(d):
    return f"""
    select cast(event_id as string) as request_id, 'ingest' as route, ts,
           case when event_id % 11 = 0 then null
                when event_id % 13 = 0 then {d.repeat("'x'", 130)}
                else 'k' || cast(user_id as string) || '-' || {d.fmt_date("ts")} end as key
    from events"""


@view("orders", "customer")
def v_analyses(d):
    return f"""
    select cast(o_orderkey as string) as call_id,
           case when o_orderkey % 17 = 0 then '' else {d.fmt_date("o_orderdate")} end as call_date,
           case when o_orderkey % 29 = 0 then 'mystery'
                else {d.pick("o_orderkey % 13", C.DISPOSITIONS)} end as disposition,
           (o_orderkey % 100) / 100e0 as disposition_confidence,
           'because ' || cast(o_orderkey % 7 as string) as disposition_rationale,
           case o_orderstatus when 'F' then 'negative' when 'O' then 'neutral' else 'positive' end as sentiment,
           (o_orderkey % 50) / 50e0 as sentiment_confidence,
           o_orderpriority = '1-URGENT' as escalation,
           case when o_orderkey % 5 = 0 then '' else c_name end as full_name,
           case when o_orderkey % 3 = 0 then null else lower(c_mktsegment) || cast(o_custkey as string) || '@mail.example.com' end as email,
           case when o_orderkey % 4 = 0 then null else 'clerk' end as occupation,
           case when o_orderkey % 6 = 0 then '  ' else '5-10L' end as income_band,
           upper(c_mktsegment) as product_interest,
           '5' || lpad(cast(c_nationkey as string), 5, '0') as pincode,
           '8' || lpad(cast(o_custkey as string), 9, '0') as phone,
           'POL' || cast(o_orderkey as string) as policy_no,
           case when o_orderkey % 2 = 0 then {d.strings("'phone'")} else {d.empty_strings} end as grounded_fields
    from orders join customer on o_custkey = c_custkey"""


@view("orders")
def v_cdr(d):
    base = "'9' || lpad(cast(o_custkey as string), 9, '0')"
    layouts = ["iso", "isoT", "date", "dmy-", "dmy/", "dmyd-", "dmyd/"]
    start = "case o_orderkey % 7 " + " ".join(
        f"when {i} then {d.fmt_ts('o_orderdate', k)}" for i, k in enumerate(layouts)) + " end"
    return f"""
    select cast(o_orderkey as string) as crux_call_id,
           o_orderkey * 2 + copy as ordinal,
           case when copy = 1 then '9' || lpad(cast(o_custkey + 1 as string), 9, '0')
                else case o_orderkey % 7
                  when 0 then '+91 ' || {base} when 1 then '0' || {base} when 2 then {base} || '.0'
                  when 3 then 'NA' when 4 then {base} when 5 then '12345'
                  else substr({base}, 1, 5) || '-' || substr({base}, 6) end end as caller_number,
           case when o_orderkey % 10 = 0 then 'NA' else 'AG' || cast(o_custkey % 20 as string) end as agent_id,
           o_orderpriority as campaign,
           case when o_orderkey % 23 = 0 then 'garbage' else {start} end as start_time,
           {d.pick("o_orderkey % 6", ["MT", "MO", "in", "OUT", "", "x"])} as direction
    from (select o.*, 0 as copy from orders o where o_orderkey % 4 < 3
          union all
          select o.*, 1 as copy from orders o where o_orderkey % 4 < 3 and o_orderkey % 19 = 0) c"""


@view("customer")
def v_leads(d):
    return """
    select c_custkey * 2 + copy as ordinal,
           case when c_custkey % 3 = 0 then '0' else '' end || '9' || lpad(cast(c_custkey as string), 9, '0') as MOBILE_NO,
           case when c_custkey % 50 = 0 then 'NA' else 'L' || cast(c_custkey + copy * 1000000 as string) end as LEAD_NO,
           case when copy = 0 then c_mktsegment else ' Second Product ' end as PRODUCT_TYPE
    from (select c.*, 0 as copy from customer c
          union all
          select c.*, 1 as copy from customer c where c_custkey % 6 = 0) l"""


@view("orders")
def v_lms(d):
    texts = list(C.LMS_CROSSWALK) + [" Ringing ", None, "unknown text"]
    return f"""
    select cast(o_orderkey as string) as call_id, {d.pick("o_orderkey % 30", texts)} as lms_text
    from orders"""


@view("embeddings")
def v_embeddings(d):
    if d.name == "spark":
        vec = "transform(embedding, x -> cast(x as double))"
    else:
        vec = "cast(embedding as double[])"
    return f"""
    select cast(vec_id as string) as question_id, vec_id, {vec} as vector, label from embeddings"""


@view("embeddings")
def v_planted(d):
    if d.name == "spark":
        return """
        select question_id, vec_id, label, vector
        from (
          select question_id, vec_id, label,
                 element_at(transform(array(sqrt(aggregate(raw, 0e0, (s, x) -> s + x * x))), n -> transform(raw, x -> x / n)), 1) as vector
          from (
            select cast(e.vec_id as string) as question_id, e.vec_id, e.label,
                   case when e.label = 9 then transform(e.embedding, x -> cast(x as double))
                        else zip_with(a.anchor, e.embedding,
                             (p, q) -> cast(p as double) + 35e-2 * cast(q as double)) end as raw
            from embeddings e
            join (select label, min_by(embedding, vec_id) as anchor from embeddings group by label) a
              on a.label = e.label) r) n"""
    return """
        select question_id, vec_id, label, list_transform(raw, lambda x: x / norm) as vector
        from (
          select question_id, vec_id, label, raw,
                 sqrt(list_sum(list_transform(raw, lambda x: x * x))) as norm
          from (
            select cast(e.vec_id as string) as question_id, e.vec_id, e.label,
                   case when e.label = 9 then cast(e.embedding as double[])
                        else list_transform(list_zip(a.anchor, e.embedding),
                             lambda z: cast(z[1] as double) + 35e-2 * cast(z[2] as double)) end as raw
            from embeddings e
            join (select label, arg_min(embedding, vec_id) as anchor from embeddings group by label) a
              on a.label = e.label) r) n"""


@view("v_planted", "documents")
def v_questions(d):
    ints = d.pick("case when vec_id % 6 = 0 then vec_id % 15 else label end", C.INTENTS)
    sec = d.strings(d.pick("(vec_id + 1) % 15", C.INTENTS), d.pick("(vec_id + 2) % 15", C.INTENTS))
    return f"""
    select cast(vec_id as string) as id, vec_id, cast(vec_id % 100 as string) as call_id,
           case when vec_id % 9 = 0 then null else 'u' || cast(vec_id as string) end as utterance_id,
           text as raw_text,
           case when vec_id % 10 = 0 then '' else trim(text) end as normalized_text,
           case when vec_id % 4 = 0 then null else 'gloss ' || cast(vec_id % 37 as string) || ' ' || text end as english_gloss,
           {d.pick("vec_id % 4", C.QUESTION_TYPES)} as question_type,
           {ints} as intent,
           case when vec_id % 3 = 0 then {sec} else {d.empty_strings} end as secondary_intents,
           lang as language, (vec_id % 100) / 100e0 as confidence,
           case when vec_id % 50 = 0 then null else {d.ts("2024-01-01 00:00:00")} + {d.minutes("vec_id")} end as extracted_at,
           vec_id % 41 = 0 as human_override
    from (select d.doc_id as vec_id, d.text, d.lang, coalesce(p.label, d.doc_id % 10) as label
          from documents d left join v_planted p on p.vec_id = d.doc_id) x"""


@view("v_planted")
def v_clusters(d):
    if d.name == "spark":
        centroid = """
          select label, frequency, element_at(transform(array(sqrt(aggregate(m, 0e0, (s, y) -> s + y * y))), n -> transform(m, x -> x / n)), 1) as centroid
          from (select label, max(n) as frequency,
                       transform(array_sort(collect_list(struct(pos, v))), x -> x.v) as m
                from (select label, pos, avg(x) as v, count(*) as n
                      from (select label, posexplode(vector) as (pos, x) from v_planted where label < 9) e
                      group by label, pos) p
                group by label) c"""
    else:
        centroid = """
          select label, frequency, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) as centroid
          from (select label, max(n) as frequency, list(v order by pos) as m
                from (select label, pos, avg(x) as v, count(*) as n
                      from (select label, unnest(vector) as x, generate_subscripts(vector, 1) as pos
                            from v_planted where label < 9) e
                      group by label, pos) p
                group by label) c"""
    first = "case when label = 99 then 14 else label end"
    return f"""
    select cast(label as string) as id, cast(label as bigint) as num,
           case when label % 4 = 0 then null else 'label ' || cast(label as string) end as label,
           'canonical question ' || cast(label as string) || ' about ' || {d.pick(first, C.INTENTS)} as canonical_question,
           centroid, case when label % 2 = 0 then 'en' else 'hi' end as dominant_language,
           {d.strings(d.pick(first, C.INTENTS), d.pick("(" + first + " + 3) % 15", C.INTENTS))} as dominant_intents,
           cast(frequency as bigint) as frequency,
           {d.as_of} - {d.days("case when label = 99 then 40 else label * 2 end")} as last_updated,
           label <> 7 as is_stable
    from (select case when spare = 0 then label else 99 end as label, case when spare = 0 then frequency else 4 end as frequency, centroid
          from (select k.*, {d.sequence("0", "case when label = 0 then 1 else 0 end")} as spare from ({centroid}) k) w) u"""


@view("v_planted", "v_clusters", "events")
def v_members(d):
    if d.name == "spark":
        cos = "aggregate(zip_with(p.vector, c.centroid, (a, b) -> a * b), 0e0, (s, x) -> s + x)"
    else:
        cos = "list_dot_product(p.vector, c.centroid)"
    return f"""
    select p.question_id, c.id as cluster_id, {cos} as similarity,
           least(e.ts + {d.days("p.label * 3")}, {d.as_of}) as assigned_at
    from v_planted p join v_clusters c on c.num = p.label
    join events e on e.event_id = p.vec_id"""


@view("v_clusters")
def v_faqs(d):
    return f"""
    select id || '-' || cast(version as string) as id, id as cluster_id,
           'faq ' || id || ' v' || cast(version as string) as canonical_question,
           case when num % 2 = 0 then null else 'english faq ' || id || ' v' || cast(version as string) end as canonical_question_en,
           'answer ' || id as suggested_answer, dominant_language as language,
           5e-1 + version * 1e-1 as confidence, cast(version as bigint) as version,
           {d.ts("2024-01-01 00:00:00")} + {d.days("version")} as created_at
    from (select id, num, dominant_language, {d.sequence("1", "cast(num % 3 + 1 as int)")} as version
          from v_clusters where num < 99) v"""


@view("v_clusters")
def v_edges(d):
    return f"""
    select a.id as source, b.id as target, a.batch,
           {d.pick("(a.num + b.num) % 6", C.CLUSTER_RELATIONS)} as relation,
           ((a.num * 7 + b.num * 3 + (a.batch - 1) * 4) % 10) / 10e0 as weight,
           'reason ' || a.id || '-' || b.id || ' b' || cast(a.batch as string) as reason,
           a.num * 1000 + b.num as seq
    from (select p.*, {d.sequence("1", "case when (num + other) % 2 = 0 then 2 else 1 end")} as batch
          from (select id, num, {d.sequence("num + 1", "8")} as other from v_clusters where num < 8) p) a
    join v_clusters b on b.num = a.other"""


@view("v_clusters")
def v_verdicts(d):
    if d.name == "spark":
        cos = "aggregate(zip_with(a.centroid, b.centroid, (p, q) -> p * q), 0e0, (s, x) -> s + x)"
    else:
        cos = "list_dot_product(a.centroid, b.centroid)"
    return f"""
    select a.id as source, b.id as target, {cos} as cosine,
           (a.num + b.num) % 4 <> 0 as has_relation,
           case when (a.num + b.num * 2) % 9 = 8 then 'x'
                when (a.num + b.num * 2) % 9 = 7 then '1.3'
                else cast(((a.num * 7 + b.num * 3) % 10) / 10e0 as string) end as weight,
           {d.pick("(a.num * 2 + b.num) % 7", [" Related_To "] + C.CLUSTER_RELATIONS[1:] + ["friend_of"])} as relation,
           case when b.num % 3 = 0 then '  ' else ' because ' || b.id || ' ' end as reason,
           {d.as_of} - {d.days("(a.num + b.num) % 14")} as cached_at
    from (select id, num, centroid, {d.sequence("0", "8")} as other from v_clusters where num < 99) a
    join v_clusters b on b.num = a.other where a.num <> b.num"""


@view("events")
def v_feedback(d):
    q = "cast(event_id % 180 as string)"
    a, b = "cast(event_id % 9 as string)", "cast((event_id * 7 + user_id + 1) % 9 as string)"
    return f"""
    select cast(event_id as string) as id, ts as created_at, 'u' || cast(user_id as string) as author,
           {d.pick("event_id % 6", C.FEEDBACK_ACTIONS + ["explode_cluster"])} as action,
           case event_id % 6
             when 0 then '{{"source_id":"' || {a} || '","target_id":"' || {b} || '"}}'
             when 1 then '{{"cluster_id":"' || {a} || '"}}'
             when 2 then '{{"cluster_id":"' || {b} || '"'
                  || case when event_id % 4 < 3 then ',"intent":"' || {d.pick("user_id % 15", C.INTENTS)} || '"' else '' end
                  || case when event_id % 5 < 3 then ',"label":"new ' || cast(user_id as string) || '"' else '' end || '}}'
             when 3 then '{{"cluster_id":"' || {b} || '"}}'
             when 4 then '{{"question_id":"' || {q} || '","cluster_id":"' || {b} || '"'
                  || case when event_id % 3 = 1 then ',"similarity":0.' || cast(1 + event_id % 9 as string) else '' end || '}}'
             else '{{}}' end as payload
    from events"""


@view("v_utterances")
def v_responses(d):
    full = d.struct(
        raw_text="excerpt", normalized_text="excerpt", english_gloss="'gloss ' || call_id",
        question_type=d.pick("idx % 4", C.QUESTION_TYPES), intent=d.pick("idx % 15", C.INTENTS),
        secondary_intents=d.strings("'renewal'"), language="'en'",
        confidence="case when idx % 8 = 7 then 14e-1 else 5e-1 + (idx % 5) * 1e-1 end")
    alias = d.struct(query="excerpt", language="'ur'")
    items = d.json(d.struct(questions=d.list_of("item", "idx", "item is not null")))
    bare = d.json(d.list_of("item", "idx", "item is not null"))
    aliased = d.json(d.struct(questions=d.list_of("short_item", "idx", "short_item is not null")))
    tick = "'```json' || chr(10)"
    return f"""
    select call_id,
           case cast(call_id as bigint) % 6
             when 0 then full_json
             when 1 then {tick} || full_json || chr(10) || '```'
             when 2 then 'Sure, here it is: ' || full_json || ' Hope this helps.'
             when 3 then bare_json
             when 4 then alias_json
             else '{{"questions": [ {{"raw_text": "cut' end as response
    from (
      select call_id, {items} as full_json, {bare} as bare_json, {aliased} as alias_json
      from (select call_id, idx, {full} as item, {alias} as short_item
            from (select call_id, idx, text as excerpt from v_utterances where speaker = 'CUSTOMER'
                  union all
                  select call_id, 100 + min(idx) as idx, 'an invented line that nobody said' as excerpt
                  from v_utterances group by call_id) x) y
      group by call_id) z"""


@view("v_clusters")
def v_faq_responses(d):
    return f"""
    select id as cluster_id,
           '{{"canonical_question":"' || case when num % 3 = 0 then '  ' else ' Q' || id || ' ' end
           || '","canonical_question_en":' || case when num % 2 = 0 then 'null' else '" EN' || id || '"' end
           || ',"suggested_answer":"' || case when num % 4 = 0 then '' else 'A' || id end
           || '","confidence":' || case num % 3 when 0 then '1.4' when 1 then '"x"' else '0.8' end || '}}' as response
    from v_clusters where num < 99"""


@view("documents")
def v_docs_pii(d):
    n4 = "lpad(cast(doc_id % 10000 as string), 4, '0')"
    return f"""
    select cast(doc_id as string) as doc_id, text || ' ' || case doc_id % 6
             when 0 then '123-45-' || {n4} when 1 then '1234-5678-' || {n4}
             when 2 then 'ABCDE' || {n4} || 'F'
             when 3 then 'user' || cast(doc_id as string) || '@mail.example.com'
             when 4 then '(743) 555-' || {n4} else '' end as text
    from documents"""


@view("documents")
def v_multilang(d):
    prefix = d.pick("doc_id % 6", ["", "मेरी पॉलिसी ", "मेरी policy ", "என் ", "నా ",
                                   "mera claim kyun nahi hua hai "])
    return f"""
    select cast(doc_id as string) as doc_id, lang as supplied,
           case when doc_id % 31 = 0 then 'پالیسی ' else '' end || {prefix} || text as text,
           case when doc_id % 31 = 0 then {d.repeat("'پالیسی '", 40)} else '' end || {d.repeat(prefix, 12)} || text as call_text
    from documents"""


def ordered_closure(names) -> list[str]:
    """Views needed for ``names``, dependencies first (driver tables left out)."""
    out: list[str] = []

    def visit(name):
        if name not in VIEWS or name in out:
            return
        for dep in VIEWS[name].deps:
            visit(dep)
        out.append(name)

    for name in names:
        visit(name)
    return out


def duck_with(names) -> str:
    """``WITH`` list (without the keyword) for the DuckDB side."""
    d = DuckDialect()
    return ",\n".join(f"{n} as ({VIEWS[n].sql(d)})" for n in ordered_closure(names))
