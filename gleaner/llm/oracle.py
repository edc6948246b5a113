"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from gleaner.llm.quality import GRID, RATIOS

_WORDS = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{_WORDS}') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
p as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from p),
r as (select doc_id, count(distinct i + k) as n_repeat_words from g, (select unnest([0, 1, 2]) as k) where c > 1 group by doc_id),
f as (select w.doc_id, stratum, len(ws) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) as capitals,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (doc_id)),
s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    [if(word_chars > 0, n_symbols / word_chars, 0), if(word_chars > 0, capitals / word_chars, 0), if(n_lines > 0, n_dup_lines / n_lines, 0), if(n_words > 0, n_repeat_words / n_words, 0)] as ratios from f),
q as (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id),
n as (select stratum, count(*) filter (where quality = 1) as good, count(*) filter (where quality <> 1) as bad from s join q using (doc_id) where not base_failed group by stratum
    having count(*) filter (where quality = 1) >= ceil(ln(0.05 / {len(RATIOS)}) / ln(1 - 0.04 / {len(RATIOS)}))),
c as (select stratum, rule, step, [{", ".join(map(str, GRID))}][step] as cutoff from (select distinct stratum from n), (select unnest(range(1, {len(RATIOS) + 1})) as rule), (select unnest(range(1, {len(GRID) + 1})) as step)),
k as (select c.stratum, rule, step, cutoff, count(*) filter (where quality = 1 and ratios[rule] > cutoff) as lost, count(*) filter (where quality <> 1 and ratios[rule] > cutoff) as caught
    from c join s on s.stratum = c.stratum join q using (doc_id) where not base_failed group by all),
b as (select k.*, good, bad, (select count(*) from n) as strata, 0.04 / {len(RATIOS)} as share from k join n using (stratum)),
e as (select *, list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln(share) + (good - i) * ln(1 - share)))) as tail from b),
o as (select *, bool_and(tail <= 0.05 / ({len(RATIOS)} * strata)) over (partition by stratum, rule order by step) as passed, caught / greatest(1, bad) - 10.0 * lost / good as worth from e),
u as (select stratum, rule, arg_max(cutoff, (worth, -step)) as cutoff from o where passed and worth > 0 group by all)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not exists (select 1 from u where u.stratum = s.stratum and s.ratios[u.rule] > u.cutoff) as kept from s
"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach as (select vec_id as v, vec_id as c from embeddings union select reach.v, l.b from reach join l on l.a = reach.c),
g as (select v, min(c) as component_id from reach group by v)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join g on g.v = vec_id
"""

ARCHIVES = """
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as h from pages),
w as (select *, max(page_id) over (partition by h, octet_length(payload)) as winner,
    list_transform(range(0, 32), lambda i: list_reduce(list_transform(range(0, 3), lambda j: instr('0123456789abcdef', substr(h || '0', cast(floor(5 * i / 4) as integer) + 1 + j, 1)) - 1), lambda x, y: 16 * x + y)) as threes from p)
select page_id, octet_length(payload) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((threes[i + 1] >> (7 - (5 * i) % 4)) & 31 as integer) + 1, 1)), '') as payload_digest,
    if(winner = page_id, 'response', 'revisit') as record_type, if(winner = page_id, null, winner) as refers_to from w
"""

EXACT = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id nulls last)
"""

FILL_IN_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as r from d),
c as (select *, len(units) as n, least(r[1] % (n + 1), r[2] % (n + 1)) as lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) as hi,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(units[1:lo], '') as prefix, array_to_string(units[lo + 1:hi], '') as middle, array_to_string(units[hi + 1:], '') as suffix from c)
select doc_id, n, form, if(form = 'plain', null, length(prefix)) as prefix_chars, if(form = 'plain', null, length(middle)) as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(t) as restored_sha256 from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_exact_dedup": EXACT, "op12_fill_in_middle": FILL_IN_MIDDLE, "op5_quality_rules": QUALITY, "op8_embedding_near_dedup": EMBEDDINGS, "op10_warc_archives": ARCHIVES}
