"""The SQL that the chunking queries are checked against."""

from __future__ import annotations

from bidweave.config import SETTINGS
from bidweave.functions.text import TYPE_LABELS

_W = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_L = r"\p{L}\p{M}\p{Nd}\p{Pc}\p{Nl}\x{200c}\x{200d}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"cast(coalesce(len(regexp_extract_all({x}, '[{_L}]+|[^{_L}{_W}]')), 0) as integer)"


def capitals(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


def headed(source: str, name: str, headings: list[str]) -> str:
    """CTEs up to ``name``: the columns of ``source`` (which has ``line``) and ``heading``."""
    known = ", ".join(f"'{h}'" for h in headings)
    return rf"""{name}_s as (select *, {strip('line')} s from {source}),
{name}_c as (select *, regexp_replace(s, '\b([A-Z]{{4,}})I\b', '\1', 'g') c, len(regexp_extract_all(s, '\d')) dg,
  trim(regexp_extract(s, '^(?:Section|SECTION|Article|ARTICLE|Part|PART)\s+([0-9A-Za-z.-]+(?:\s*[-:–]\s*[^\n]+)?)', 0)) sec, trim(regexp_extract(s, '^#{{1,4}}\s+([^\n]+)', 1)) mk from {name}_s),
{name} as (select * exclude (s, c, dg, sec, mk), case
  when s = '' or starts_with(s, '|') or ends_with(s, '|') or regexp_matches(s, '(?i)\bEND\s+OF\s+(?:ADDENDUM|SOLICITATION|DOCUMENT|SECTION|FILE|PROPOSAL)\b') or regexp_matches(s, '^[A-Z][a-zA-Z]+,\s+[A-Z][a-zA-Z]+(?:\s+[A-Z]\.?)?$')
    or regexp_matches(upper(s), '^(?:BUYER|CONTACT|OFFICER|NAME:|AFFIANT|REPRESENTATIVE)') or regexp_matches(s, '^\w+[-_]\w+$') or (dg > 0 and (dg / length(s) > 0.18 or dg >= 5)) then null
  when sec <> '' then sec when regexp_matches(s, '(?i)^addendum') then {capitals('s')} when mk <> '' and not regexp_matches(mk, '^\w+[-_]\w+$') then mk
  when regexp_matches(c, '\p{{Lu}}') and upper(c) = c and length(c) between 5 and 54 and not ends_with(c, '.') and not contains(c, ',') and (len(regexp_extract_all(c, '\b[A-Za-z]{{3,}}\b')) >= 2 or list_has_any(regexp_extract_all(c, '\b[A-Za-z]{{3,}}\b'), [{known}]))
    then regexp_replace({capitals('c')}, '([a-zA-Z]{{4}})[iI]$', '\1') end heading from {name}_c)"""


def tables(source: str, name: str) -> str:
    """CTEs up to ``name`` (id, part, piece, pieces): the pieces of the Markdown tables (id, md) of ``source``."""
    return rf"""{name}_l as (select id, md, list_filter(string_split(md, chr(10)), lambda x: trim(x) <> '') l from {source}),
{name}_b as (select *, array_to_string(l[1:2], chr(10)) head from {name}_l where length(md) > {SETTINGS.table_max_chunk_size} and len(l) > 2),
{name}_r as (select id, 3 i, 0 part, length(head) + 1 + length(l[3]) n from {name}_b
  union all select r.id, r.i + 1, case when r.n >= {SETTINGS.chunk_size * 4} then r.part + 1 else r.part end, case when r.n >= {SETTINGS.chunk_size * 4} then length(head) else r.n end + 1 + length(l[r.i + 1]) from {name}_r r join {name}_b b using (id) where r.i < len(l)),
{name}_p as (select id, part, any_value(head) || chr(10) || string_agg(l[i], chr(10) order by i) piece from {name}_r join {name}_b using (id) group by 1, 2
  union all select id, 0, md from {name}_l where not (length(md) > {SETTINGS.table_max_chunk_size} and len(l) > 2)),
{name} as (select *, count(*) over (partition by id) pieces from {name}_p)"""


def clip(x: str, size: int, least: int) -> str:
    head = f"substring({x}, 1, {size})"
    at = f"instr(reverse({head}), ' ')"
    return f"case when length({x}) > {size} then trim(case when {at} > 0 and {size} - {at} > {least} then left({head}, {size} - {at}) else {head} end) else {x} end"


def _id(page_suffix: str, text: str) -> str:
    """SQL of a chunk id over bid_id, file_name and page_number."""
    return rf"coalesce(bid_id, '') || '_' || regexp_replace(regexp_replace(regexp_replace(coalesce(file_name, ''), '(.)\.[^.]*$', '\1'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_p' || coalesce(cast(page_number as varchar), '') || '_' || {page_suffix} || '_' || substring(md5(concat_ws('_', coalesce(bid_id, ''), coalesce(file_name, ''), coalesce(cast(page_number as varchar), ''), {page_suffix}, substring({text}, 1, 100))), 1, 8)"


def _packed(headings: list[str], marker: str, tabled: bool) -> str:
    """CTEs up to n5, the chunks of all pages, with the tables of chunks put on their pages or without."""
    kinds = " ".join(f"when '{k}' then '{v}'" for k, v in TYPE_LABELS.items())
    return rf"""with recursive
pg as (select page_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(doc_type) doc_type, any_value(page_number) page_number, any_value(cleaned_text) t from parsed_pages group by 1),
ct as (select bid_id, file_name, page_number, string_agg(md, chr(10) || chr(10) order by md) md from (select distinct bid_id, file_name, page_number, regexp_replace(text, '^[^\n]*\n', '') md from chunks where is_table and {str(tabled).lower()}) group by 1, 2, 3),
fs as (select bid_id, file_name, any_value(addendum_number) addendum_number from source_files group by 1, 2),
d as (select pg.* exclude t, addendum_number, case when md is not null then coalesce(t, '') || chr(10) || chr(10) || '{marker}' || chr(10) || chr(10) || md else coalesce(t, '') end t from pg left join ct using (bid_id, file_name, page_number) left join fs using (bid_id, file_name)),
c as (select *, case when contains(t, '{marker}') then left(t, instr(t, '{marker}') - 1) else t end prose, case when contains(t, '{marker}') then substring(t, instr(t, '{marker}') + {len(marker)}) else '' end rest from d),
pa as (select page_id, unnest(list_filter(list_transform(string_split(prose, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> '')) p, generate_subscripts(list_filter(list_transform(string_split(prose, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), 1) k from c),
sl as (select page_id, k, case when {tokens('p')} > {SETTINGS.long_paragraph} then list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '') else [p] end l from pa),
se as (select page_id, row_number() over (partition by page_id order by k, j) - 1 i, s, {tokens('s')} n from (select page_id, k, unnest(l) s, generate_subscripts(l, 1) j from sl)),
sg as (select *, sum(n) over (partition by page_id order by i) cum from se),
ln as (select page_id, 's' src, i, unnest(string_split(s, chr(10))) line, generate_subscripts(string_split(s, chr(10)), 1) j from sg
  union all select page_id, 't', 0, unnest(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1:5]), generate_subscripts(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')[1:5], 1) from c
  union all select page_id, 'p', 0, unnest(list_filter(string_split(prose, chr(10)), lambda x: trim(x) <> '')[1:5]), generate_subscripts(list_filter(string_split(prose, chr(10)), lambda x: trim(x) <> '')[1:5], 1) from c),
{headed('ln', 'hd', headings)},
h as (select page_id, i, arg_max(heading, j) filter (where heading is not null) h from hd where src = 's' group by 1, 2),
f as (select page_id, heading from hd where src = 's' and i = 0 and trim(line) <> '' qualify row_number() over (partition by page_id order by j) = 1),
a as (select page_id, arg_min(heading, j) filter (where heading is not null and src = 't') any_, arg_min(heading, j) filter (where heading is not null and src = 'p') prose_ from hd group by 1),
la as (select page_id, arg_max(h, i) filter (where h is not null) last_ from h group by 1),
m as (select c.*, f.heading first_, any_, prose_, last_value(last_ ignore nulls) over (partition by bid_id, file_name order by page_number nulls first, page_id rows between unbounded preceding and 1 preceding) before_ from c left join f using (page_id) left join a using (page_id) left join la using (page_id)),
ta as (select x.page_id, x.i, min(y.i) tail from sg x join sg y on x.page_id = y.page_id and y.i < x.i and (y.i = x.i - 1 or x.cum - x.n - (y.cum - y.n) <= {SETTINGS.chunk_overlap}) group by 1, 2),
g as (select sg.*, h.h, tail from sg left join h using (page_id, i) left join ta using (page_id, i)),
r as (select page_id, g.i, 0 lo, g.n, 0 k, coalesce(first_, before_, prose_, 'General') own, coalesce(g.h, first_, before_) act from g join m using (page_id) where g.i = 0
  union all select r.page_id, g.i, case when r.n + g.n > {SETTINGS.chunk_size} then greatest(r.lo, g.tail) else r.lo end,
    case when r.n + g.n > {SETTINGS.chunk_size} then (select g.cum - z.cum + z.n from g z where z.page_id = r.page_id and z.i = greatest(r.lo, g.tail)) else r.n + g.n end,
    case when r.n + g.n > {SETTINGS.chunk_size} then r.k + 1 else r.k end, case when r.n + g.n > {SETTINGS.chunk_size} then coalesce(g.h, r.act) else r.own end, coalesce(g.h, r.act) from r join g on g.page_id = r.page_id and g.i = r.i + 1),
e as (select page_id, k, lo, own, max(i) hi from r group by 1, 2, 3, 4),
b as (select e.page_id, 100000 + k o, false is_table, 'c' || k suffix, own section, string_agg(s, chr(10) || chr(10) order by sg.i) body from e join sg on sg.page_id = e.page_id and sg.i between lo and hi group by e.page_id, k, own),
ml as (select page_id, list_filter(list_transform(string_split_regex(rest, '\n\s*\n'), lambda x: {strip('x')}), lambda x: x <> '') l from c where rest <> ''),
mt as (select page_id || '/' || (j - 1) id, md from (select page_id, unnest(l) md, generate_subscripts(l, 1) j from ml)),
{tables('mt', 'tp')},
tb as (select cast(split_part(id, '/', 1) as bigint) page_id, cast(split_part(id, '/', 2) as integer) * 1000 + part o, true is_table, 'tbl_' || split_part(id, '/', 2) || case when pieces > 1 then '_part' || part else '' end suffix, piece body from tp),
u as (select page_id, o, is_table, suffix, section, body from b union all select page_id, o, is_table, suffix, coalesce(any_, before_, case when doc_type = 'specs' then 'Specifications' else 'Table (p.' || coalesce(cast(page_number as varchar), '?') || ')' end), body from tb join m using (page_id)),
n1 as (select u.*, m.* exclude page_id, row_number() over (partition by bid_id, file_name, page_number, page_id order by o) - 1 seq, regexp_replace(regexp_replace(coalesce(file_name, ''), '(.)\.[^.]*$', '\1'), '[_\-]+', ' ', 'g') ti from u join m using (page_id)),
n2 as (select *, trim(regexp_replace(regexp_replace(trim(ti), '(?i)\b(?:SOURCING\s*\d+|Bid\s+Information|\{{\d+\}}|BidNet\s+Direct)\b', '', 'g'), '\s+', ' ', 'g')) tt, coalesce(nullif(trim(coalesce(section, '')), ''), 'General') ss from n1),
n3 as (select *, '[' || concat_ws(' | ', coalesce(bid_id, ''), case lower(coalesce(doc_type, '')) when 'addendum' then case when addendum_number > 0 then 'Addendum ' || addendum_number else 'Addendum' end {kinds} else 'RFP' end, {clip('tt', 42, 20)}, 'p.' || page_number, 'Section: ' || {clip('ss', 35, 15)}) || ']' || chr(10) || body text from n2),
n4 as (select *, {_id('suffix', 'text')} id0 from n3),
n5 as (select *, id0 || case when row_number() over w > 1 then '_' || row_number() over w else '' end chunk_id from n4 window w as (partition by id0 order by page_id, seq))"""


def pack(headings: list[str], marker: str) -> str:
    return _packed(headings, marker, True) + f" select page_id, cast(seq as integer) seq, is_table, section, chunk_id, {tokens('text')} n_tokens, md5(text) digest from n5"


def document(headings: list[str], marker: str) -> str:
    """Packed, near-copies left out, small chunks merged, blank forms left out."""
    return _packed(headings, marker, False) + rf""", {_kept("n5", "seq, chunk_id", "text")},
k1 as (select *, case when contains(text, chr(10)) then regexp_replace(text, '^[^\n]*\n', '') else text end bd from n5 where chunk_id in (select chunk_id from kp where kept)),
k2 as (select *, len(list_filter(string_split_regex(bd, '[{_W}]+'), lambda x: x <> '')) < {SETTINGS.min_chunk_words} and not coalesce(is_table, false) and row_number() over v > 1 small from k1 window v as (partition by bid_id, file_name, page_number order by seq)),
k3 as (select *, sum(case when small then 0 else 1 end) over (partition by bid_id, file_name, page_number order by seq) island from k2),
k4 as (select bid_id, file_name, page_number, island, count(*) n, arg_min(chunk_id, seq) first_, string_agg(case when small then bd else text end, chr(10) || chr(10) order by seq) t from k3 group by 1, 2, 3, 4)
select bid_id, file_name, page_number, cast(island as bigint) seq, case when n > 1 then {_id("'merged'", "t")} else first_ end chunk_id, cast(n as integer) n_parts, md5(t) digest from k4 where len(regexp_extract_all(t, '(?i)\[unfilled/blank\]')) < 5"""


def heading_lines(headings: list[str]) -> str:
    return f"with l as (select distinct page_id, unnest(string_split(cleaned_text, chr(10))) line from parsed_pages), {headed('l', 'h', headings)} select heading, count(distinct page_id) pages from h where heading is not null group by 1"


SPLIT_TABLES = "with recursive t as (select chunk_id id, any_value(regexp_replace(text, '^[^\\n]*\\n', '')) md from chunks where is_table group by 1), " + tables("t", "p") + " select id chunk_id, cast(part as integer) part, cast(length(piece) as integer) n_chars from p"

def _kept(source: str, order: str, text: str) -> str:
    """CTEs up to kp (chunk_id, kept): the greedy choice among the chunks of each page of ``source``."""
    return rf"""kw as (select *, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '^\[[^\n]*\]\n', '')), '[{_L}]+'), lambda x: length(x) >= 3)) w, row_number() over (partition by bid_id, file_name, page_number order by {order}) i from {source} where file_name is not null and page_number is not null),
kr as (select bid_id, file_name, page_number, i, chunk_id, true kept, [w] k from kw where i = 1
  union all select w.bid_id, w.file_name, w.page_number, w.i, w.chunk_id, x.kept, case when x.kept then list_append(r.k, w.w) else r.k end from kr r join kw w on w.bid_id is not distinct from r.bid_id and w.file_name = r.file_name and w.page_number = r.page_number and w.i = r.i + 1,
    lateral (select not coalesce(list_bool_or(list_transform(r.k, lambda q: len(q) > 0 and len(w.w) > 0 and len(list_intersect(q, w.w)) / least(len(q), len(w.w)) > {SETTINGS.near_dup_overlap})), false) kept) x),
kp as (select chunk_id, kept from kr union all select chunk_id, true from {source} where file_name is null or page_number is null)"""


NEAR_COPIES = f"with recursive c as (select chunk_id, any_value(bid_id) bid_id, any_value(file_name) file_name, any_value(page_number) page_number, any_value(text) t from chunks group by 1), {_kept('c', 'chunk_id', 't')} select chunk_id, kept from kp"
