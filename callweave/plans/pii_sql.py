"""DuckDB side of the personal-data jobs, shared by several queries."""

from callweave import constants as C
from callweave.functions.pii import wide_pattern


def _one(rank: int, kind: str, source: str) -> str:
    pattern = wide_pattern(C.PII_PATTERNS[kind])
    return f"""
  select doc_id, '{kind}' as type, {rank} as rank, unnest(m) as value,
         unnest(list_transform(range(1, len(m) + 1), lambda i:
           coalesce(list_sum(list_transform(g[1:i], lambda x: len(x))), 0)
           + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0))) as start_idx
  from (select doc_id, regexp_extract_all(text, '{pattern}') as m, string_split_regex(text, '{pattern}') as g
        from {source}) s"""


def hits(source: str = "v_docs_pii") -> str:
    parts = " union all ".join(_one(i, k, source) for i, k in enumerate(C.PII_PATTERNS))
    return f"""
found as (select doc_id, type, rank, value, cast(start_idx as bigint) as start_idx,
                 cast(start_idx + len(value) as bigint) as end_idx from ({parts}) f),
hits as (
  select * from found f
  where not (type = 'PHONE' and exists (
    select 1 from found s where s.doc_id = f.doc_id and s.type = 'SSN'
      and ((s.start_idx <= f.start_idx and f.start_idx < s.end_idx)
           or (s.start_idx < f.end_idx and f.end_idx <= s.end_idx)))))"""


def kept(source: str = "v_docs_pii") -> str:
    return hits(source) + """,
kept as (
  select doc_id, type, rank, value, start_idx, end_idx from (
    select *, row_number() over (partition by doc_id order by start_idx, end_idx, rank) as rn from hits) a where rn = 1
  union all
  select doc_id, type, rank, value, start_idx, end_idx from (
    select h.*, row_number() over (partition by h.doc_id order by h.start_idx, h.end_idx, h.rank) as rn
    from kept k join hits h on h.doc_id = k.doc_id and h.start_idx >= k.end_idx) b where rn = 1)"""
