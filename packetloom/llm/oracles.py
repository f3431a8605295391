"""SQL twins of the text operators, for those that SQL can express at the size of the small test tables."""

_WHITE = r"[\x20\x09-\x0D]"


def _removed(pattern: str) -> str:
    """How many characters of the text a pattern of single characters matches."""
    return f"(length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))"


VECTORS = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) and list_inner_product(cast(embedding as double[]), cast(embedding as double[])) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, c) as (select vec_id, vec_id from embeddings union select e.b, r.c from reach r join e on e.a = r.vec_id)
select r.vec_id, (select count(*) from e where e.a = r.vec_id) as n_links, min(c) as component_id, min(c) = r.vec_id as kept from reach r group by r.vec_id
"""

RULES = f"""
with t as (
  select doc_id, text, list_filter(string_split_regex(text, '{_WHITE}+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from (select doc_id, coalesce(text, '') as text from documents)),
g as (select doc_id, i, count(*) over (partition by doc_id, w) > 1 as again from (select doc_id, i, array_to_string(ws[i:i + 2], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from t))),
r as (select doc_id, count(distinct i + d) as n from g, (values (0), (1), (2)) v(d) where again group by doc_id),
s as (
  select t.doc_id, text, len(ls) as n_lines, len(ws) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars, {_removed("[#*$%&|<>]")} as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from t left join r on r.doc_id = t.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (
    10 * n_symbols > 3 * n_words or 2 * {_removed("[A-Z]")} > {_removed("[A-Za-z]")} or 3 * {_removed("!")} > n_words or 2 * n_dup_lines > n_lines
    or not word_chars between 2 * n_words and 16 * n_words
    or 2 * (strlen(text) - {_removed("[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]")}) < strlen(text) - {_removed(_WHITE)}) as kept
from s
"""

SHINGLES = f"""
with recursive t as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WHITE}+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as sh from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from t where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
e as (select o.a, o.b from o join n x on x.doc_id = o.a join n y on y.doc_id = o.b where 100 * o.o >= 80 * (x.n + y.n - o.o)),
reach(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from reach r join e on e.a = r.doc_id)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(c) as component_id from reach r left join n on n.doc_id = r.doc_id group by r.doc_id
"""

#: CRC-32 of the decimal ids, byte by byte with the table of its polynomial.
_CRC = """
table256 as (select list(c order by b) as t from (
  select b, list_reduce(list_concat([b], range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) as c from range(256) r(b))),
crcs as (
  select s, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as crc
  from table256, (select s, list_transform(range(1, strlen(s) + 1), lambda i: cast(ascii(s[i]) as bigint)) as bytes from (select distinct cast(doc_id as varchar) as s from documents where doc_id is not null)))
"""


def _leaf(text: str) -> str:
    fields = [f"cast({text if c == 'text' else c} as varchar)" for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"


MANIFEST = f"""
with recursive {_CRC},
leaf as (
  select doc_id, coalesce('s' || source, 'n') as tree, {_leaf("text")} as leaf, case when crc % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as changed
  from documents left join crcs on s = cast(doc_id as varchar)),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as place from leaf),
nodes(tree, level, idx, h, n) as (
  select tree, 0, place, leaf, count(*) over (partition by tree) from placed
  union all select tree, level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (any_value(n) + 2) // 3 from nodes where n > 1 group by tree, level, idx // 3),
subroots as (select tree, h as subroot, row_number() over (order by tree) - 1 as place from nodes where n = 1),
tops(level, idx, h, n) as (
  select 0, place, subroot, count(*) over () from subroots
  union all select level + 1, idx // 3, sha256(string_agg(h, '' order by idx)), (any_value(n) + 2) // 3 from tops where n > 1 group by level, idx // 3),
runs as (select tree, level, idx // 3 as run, list(h order by idx) as hs from nodes where n > 1 group by all),
top_runs as (select level, idx // 3 as run, list(h order by idx) as hs from tops where n > 1 group by all),
up(doc_id, leaf, tree, level, idx, seen, folded) as (
  select doc_id, leaf, tree, 0, place, '', changed from placed
  union all
  select doc_id, leaf, u.tree, u.level + 1, idx // 3, seen || array_to_string(list_concat(hs[:idx % 3], hs[idx % 3 + 2:]), ''), sha256(array_to_string(list_concat(hs[:idx % 3], [folded], hs[idx % 3 + 2:]), ''))
  from up u join runs r on r.tree = u.tree and r.level = u.level and r.run = idx // 3),
ended as (select * from up u where level = (select max(level) from nodes n where n.tree = u.tree)),
over(doc_id, leaf, subroot, level, idx, seen, folded) as (
  select doc_id, leaf, subroot, 0, place, seen, folded from ended e join subroots s on s.tree = e.tree
  union all
  select doc_id, leaf, subroot, o.level + 1, idx // 3, seen || array_to_string(list_concat(hs[:idx % 3], hs[idx % 3 + 2:]), ''), sha256(array_to_string(list_concat(hs[:idx % 3], [folded], hs[idx % 3 + 2:]), ''))
  from over o join top_runs r on r.level = o.level and r.run = idx // 3)
select doc_id, leaf, subroot, h as root, sha256(seen) as proof_sha256, folded as folded_root, folded = h as verified
from over o join tops t on t.n = 1 and t.level = o.level
"""

AUDIT = r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
v as (select lang, term from w group by all having count(distinct row) >= 3),
size as (select lang, count(*) as v from v group by lang),
c as (select lang, source, term, count(*) as n from w semi join v using (lang, term) group by all),
g as (select distinct lang, source from d),
total as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by all),
p as (
  select g.lang, g.source, v.term, coalesce(c.n, 0) as n, cast(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.n + s.v) as bigint) as p
  from g join v using (lang) join size s using (lang) join total t using (lang, source) left join c using (lang, source, term)),
q as (select lang, term, cast(1 + (1000000000 * (sum(n) + 1)) // (any_value(all_n) + any_value(s.v)) as bigint) as q from p join size s using (lang) join (select lang, sum(n) as all_n from total group by lang) using (lang) group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = a.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked
"""
