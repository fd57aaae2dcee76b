"""The registered queries over the corpus operators, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import alignment, decontaminate, language_id, license_scan, line_dedup, merkle, mixing, packing, pii_crf, quality_rules, simhash, substring_dedup, suffix_dedup
from callweave.llm.license_texts import TEXTS
from callweave.session import cut, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_register(r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
p as (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as gram from p),
n as (select rid, gram from g group by rid, gram having count(*) > 1),
r as (select distinct g.rid, i + o.j as at from g join n on n.rid = g.rid and n.gram = g.gram cross join (select unnest([0, 1, 2]) as j) o),
c as (select rid, count(*) as n_repeat from r group by rid),
m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words
      from w left join c on c.rid = w.rid),
b as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
        + case when 10 * n_symbols > n_words then 4 else 0 end + case when 2 * n_dup_lines > n_lines then 8 else 0 end
        + case when word_chars < 2 * n_words then 16 else 0 end + case when word_chars > 20 * n_words then 32 else 0 end)::bigint as fail_bits
      from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept,
       n_lines, fail_bits
from b""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, folder, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~quality_rules.passes(F.col("fail_bits"), 1)).alias("base_failed"),
                       quality_rules.passes(F.col("fail_bits"), 3).alias("kept"), "n_lines", "fail_bits")


@_register(r"""
with recursive s as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as size,
        ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as dice from documents),
n as (select count(*) as docs, coalesce(sum(size), 0)::bigint as words, greatest(1, round(sqrt(count(*)))::bigint) as groups,
        least(256, greatest(1, coalesce(sum(size), 0)::bigint // 65536)) as block from s),
t as (select source, sum(size)::bigint as source_size from s group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as place from t),
w as (select *, [5, 2, 1][place % 3 + 1]::double as weight from r),
l as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0))
        / (sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0)) as level from w),
f as (select level as fit from l where level * weight <= 3 * source_size order by source_size / weight, place limit 1),
g as (select source, place, source_size, least(weight * fit, 3.0 * source_size)::double as target from l left join f on true),
h as (select *, sum(target) over (order by place) / sum(target) over () as high, lead(place) over (order by place) is null as ends from g where target > 0),
i as (select place, coalesce(lag(high) over (order by place), 0) as low, case when ends then 2.0 else high end as high from h),
b as (select 0 as k union all select k + 1 from b where k < 31),
o as (select slot, sum(((slot >> k) & 1) / pow(2.0, k + 1)) as x from (select unnest(range(0, (select (words + block - 1) // block from n))) as slot) cross join b group by slot),
c as (select place, count(*) as slots from o join i on x >= low and x < high group by place),
d as (select s.doc_id, s.source, s.size, g.source_size, g.target, coalesce(c.slots, 0) * (select block from n) as upto,
        sum(s.size) over (partition by s.source order by s.dice % (select groups from n), s.dice, s.doc_id nulls first, s.size rows between unbounded preceding and current row) - s.size as start
      from s join g on g.source is not distinct from s.source left join c on c.place = g.place)
select doc_id, size, source_size, target, (least(greatest(upto - start, 0), size) + least(greatest(upto - start - source_size, 0), size)
        + least(greatest(upto - start - 2 * source_size, 0), size))::bigint as taken, source
from d""")
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(_table(spark, folder, "documents")).drop("key")


@_register(r"""
with dw as (select row_number() over () as rid, doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bw as (select row_number() over () as bid, item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
b13 as (select distinct item_id, array_to_string(ws[i:i + 12], ' ') as win from (select item_id, ws, unnest(range(1, len(ws) - 11)) as i from bw where len(ws) >= 13)),
d13 as (select rid, i, array_to_string(ws[i:i + 12], ' ') as win from (select rid, ws, unnest(range(1, len(ws) - 11)) as i from dw where len(ws) >= 13)),
short as (select distinct item_id, ws, len(ws) as n from bw where len(ws) between 1 and 12),
lens as (select distinct n from short),
ds as (select rid, i, n, array_to_string(ws[i:i + n - 1], ' ') as win from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from dw, lens where len(ws) >= n)),
m as (select rid, i, 13 as n, item_id from d13 join b13 using (win)
      union all select rid, i, ds.n, item_id from ds join short on short.n = ds.n and array_to_string(short.ws, ' ') = ds.win),
p as (select distinct rid, unnest(range(i, i + n)) as at from m),
h as (select rid, count(*) as n_hit from p group by rid),
t as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct rid, item_id::varchar as item from m where item_id is not null) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from dw left join h on h.rid = dw.rid left join t on t.rid = dw.rid""".replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.verdicts(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_register()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.grouped(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '[\n\r]+', ' ', 'g'),
  '(?i)</?(p|div|li|ul|ol|nav|header|footer|article|section|h[1-6]|br|tr|table|title|body|head|html)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
  ' *\n[ \n]*', chr(10), 'g')"""


@_register(rf"""
with p as (select row_number() over () as rid, page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') as host,
             {_HTML} as text from pages),
l as (select rid, host, k, ls[k] as line, trim(ls[k], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as own
      from (select rid, host, ls, unnest(range(1, len(ls) + 1)) as k from (select rid, host, string_split(text, chr(10)) as ls from p))),
c as (select host, own, count(distinct rid) as n from l where own <> '' group by host, own having count(distinct rid) >= 3),
t as (select host, count(*) as total from p group by host),
f as (select c.host, own from c join t on t.host is not distinct from c.host where n > 0.07 * total),
m as (select rid, k, line, l.own, f.own is not null as gone from l left join f on f.host is not distinct from l.host and f.own = l.own),
r as (select rid, count(*) filter (where own <> '')::bigint as n_lines, count(*) filter (where gone)::bigint as n_removed,
        string_agg(line, chr(10) order by k) filter (where not gone) as kept from m group by rid)
select page_id, host, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       case when text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from p left join r on r.rid = p.rid""")
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.visible_lines(F.col("html")).alias("text"))
    found = line_dedup.line_counts(cut(pages, "page_lines"), "host", "text")  # three passes read the lines: parse once
    return found.select("page_id", "host", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _known_sql(texts: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{name}', '{text.replace("'", "''")}')" for name, text in texts)
    return f"select sha256({license_scan.canonical_sql('text')}) as digest, min(license) as license from (values {rows}) v(license, text) group by 1"


@_register(rf"""
with k as ({_known_sql(TEXTS)}), n as ({_known_sql(license_scan.notices())}),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
l as (select rid, line from (select rid, unnest(string_split(t, chr(10))) as line from d) where trim(line, ' ') <> ''),
m as (select rid, license from (select rid, sha256({license_scan.canonical_sql('line')}) as digest from l) join n using (digest)),
r as (select rid, count(*)::bigint as n_notices, string_agg(distinct license, ',' order by license) as notices from m group by rid)
select doc_id, sha256({license_scan.canonical_sql('t')}) as canonical_sha256, k.license, coalesce(notices, '') as notices, coalesce(n_notices, 0)::bigint as n_notices
from d left join k on k.digest = sha256({license_scan.canonical_sql('t')}) left join r on r.rid = d.rid""")
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scanned(_table(spark, folder, "documents"))


@_register(r"""
with d as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from (select rid, doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d where len(ws) >= 50)),
m as (select h, min(coalesce(doc_id, 9223372036854775807)) as least from w group by h having count(*) > 1),
g as (select rid, i from w join m using (h) where coalesce(doc_id, 9223372036854775807) > least),
c as (select distinct rid, unnest(range(i, i + 50)) as pos from g),
k as (select rid, ws[pos] as word, pos from (select rid, ws, unnest(range(1, len(ws) + 1)) as pos from d)),
r as (select k.rid, count(c.pos)::bigint as n_removed, string_agg(word, ' ' order by k.pos) filter (where c.pos is null) as kept
      from k left join c on c.rid = k.rid and c.pos = k.pos group by k.rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join r on r.rid = d.rid""")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.deduplicated(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_register()
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_crf.scanned(_table(spark, folder, "documents"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in ("email", "ip", "card", "phone")], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@_register()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identified(_table(spark, folder, "documents"))


@_register()
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.deduplicated(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


_MERKLE_FIELDS = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_LOWER_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TREE = """
{p}n as (select 0 as k, g, slot, n, h from {p}0
  union all select k + 1, g, slot // 8, (n + 7) // 8, sha256(string_agg(h, '' order by slot)) from {p}n where n > 1 group by k, g, slot // 8, n),
{p}s as (select l.g, l.slot, a.k, coalesce(string_agg(b.h, '' order by b.slot) filter (where b.slot < a.slot), '') as lo,
           coalesce(string_agg(b.h, '' order by b.slot) filter (where b.slot > a.slot), '') as hi
         from {p}0 l join {p}n a on a.g = l.g and a.n > 1 and a.slot = l.slot // (8 ** a.k)::bigint
         join {p}n b on b.g = a.g and b.k = a.k and b.slot // 8 = a.slot // 8 group by l.g, l.slot, a.k),
{p}r as (select g, h from {p}n where n = 1)"""


@_register(rf"""
with recursive bits as (select i, i as x, 0 as b from range(256) t(i) union all select i, xor(x >> 1, 3988292384 * (x & 1)), b + 1 from bits where b < 8),
crc as (select list(x order by i) as t from bits where b = 8),
f as (select doc_id, coalesce('v' || lang, 'n') as g, sha256({_MERKLE_FIELDS.format(text="text")}) as h,
        case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)),
                                  lambda a, c: xor(t[(xor(a, c) & 255) + 1], a >> 8)), 4294967295) % 3 = 0
             then sha256({_MERKLE_FIELDS.format(text=_LOWER_AZ)}) end as other from documents, crc),
leaf_0 as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as slot, count(*) over (partition by g) as n from f),{_TREE.format(p="leaf_")},
top_0 as (select '' as g, g as own, row_number() over (order by g) - 1 as slot, count(*) over () as n, h from leaf_r),{_TREE.format(p="top_")},
steps as (select g, slot, k, lo, hi from leaf_s union all
          select a0.g, a0.slot, s.k + 1000, s.lo, s.hi from leaf_0 a0 join top_0 b0 on b0.own = a0.g join top_s s on s.slot = b0.slot),
p as (select g, slot, list({{'l': lo, 'r': hi}} order by k) as way, string_agg(lo || hi, '' order by k) as proof from steps group by g, slot),
fold as (select a0.g, a0.slot, 0 as k, coalesce(other, h) as h, way from leaf_0 a0 left join p on p.g = a0.g and p.slot = a0.slot
         union all select g, slot, k + 1, sha256(way[k + 1].l || h || way[k + 1].r), way from fold where k < len(way))
select doc_id, a0.h as leaf, ar.h as subroot, br.h as root, sha256(coalesce(p.proof, '')) as proof_sha256, fold.h as folded_root, fold.h = br.h as verified
from leaf_0 a0 join leaf_r ar on ar.g = a0.g cross join top_r br left join p on p.g = a0.g and p.slot = a0.slot
join fold on fold.g = a0.g and fold.slot = a0.slot and fold.k = coalesce(len(fold.way), 0)""")
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    copy = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.lower_az(F.col("text"))).otherwise(F.col("text"))
    found = merkle.manifest(docs, changed={"text": copy})
    again = merkle.folded(F.col("other"), F.col("steps"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")).alias("proof_sha256"), again.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


@_register()
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


@_register()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(_table(spark, folder, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
