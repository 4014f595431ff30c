"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re
import string

from .chat import CONTROLS, END, SEP, START
from .quality import BOILERPLATE, LEAST_LEFT, LEAST_WORDS, MOST_REPEATED

WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# Components of links (a, b), both directions given: the smallest node each node reaches.
_REACH = """reach(a, b) as (select {key}, {key} from nodes union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by 1)"""

OP1 = rf"""with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') as w from documents),
nodes as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as s from nodes),
links as (select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  group by 1, 2, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
{_REACH.format(key="doc_id")}
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from nodes join least on doc_id = a"""

_DIGITS = ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::int >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
OP2 = f"""with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as h,
  min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, payload_bytes, concat({_DIGITS}) as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from p"""

_ESCAPES = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS).replace("'", "''")
OP3 = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m as (select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text) <> role, true) as first,
  length(text) + len(regexp_extract_all(text, '{_ESCAPES}')) as chars from t),
c as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
  sum(chars + case when first then {len(START) + 1 + len(END) + 1} + length(role) else {len(SEP)} end)::bigint as formatted_chars from m group by 1)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from c"""

OP4 = f"""with recursive nodes as (select vec_id, embedding::double[] as v from embeddings),
good as (select vec_id, v from nodes where v is not null and len(v) > 0 and list_bool_and([x is not null and isfinite(x) for x in v]) and list_bool_or([x <> 0 for x in v])),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.95),
degree as (select a as vec_id, count(*) as n from links group by 1),
{_REACH.format(key="vec_id")}
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from nodes join least on vec_id = a left join degree using (vec_id)"""

_FURNITURE = "|".join(BOILERPLATE)
OP6 = rf"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
windows as (select doc_id, unnest([{{'i': i, 'g': w[i:i + 2]}} for i in range(1, len(w) - 1)], recursive := true) from d where len(w) > 2),
again as (select doc_id, unnest(list(i)) as i from windows group by doc_id, g having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from again, (values (0), (1), (2)) as s(k) group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
counted as (select doc_id, line, len(regexp_extract_all(line, '{WORD}')) as n, len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols,
  len(regexp_extract_all(line, '[!?]{{2,}}')) as shouted, regexp_matches(rtrim(line, {_BLANKS}), '[.!?…:;。！？]["''”’»)\]]*$') as ended from lines),
judged as (select doc_id, count(*) filter (n > 0) - count(distinct line) filter (n > 0) as dup,
  sum(n) filter (not (5 * symbols > n or 5 * shouted > n or (n < 4 and not ended) or (n < 30 and regexp_matches(lower(line), '{_FURNITURE}')))) as rest from counted group by 1),
all_of as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, dup::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
  coalesce(rest, 0)::bigint as n_left from d join judged using (doc_id) left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed, n_left,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and 100 * n_left >= {LEAST_LEFT} * n_words as kept from all_of"""


OP12 = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
counts as (select lang, phrase, length, count(*) as f from (select lang, k as length, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase
  from words, (values (1), (2), (3)) as t(k)) group by all),
totals as (select lang, sum(len(w))::bigint as n from words group by 1),
cuts as (select lang, phrase, length, f as a, unnest(range(1, length)) as k, string_split(phrase, ' ') as w from counts where length > 1 and f >= 10),
met as (select c.*, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score from cuts c
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[:c.k], ' ') join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select lang, phrase, a, length, w, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score from met group by all),
held as (select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as more from best, (values (1), (2)) as t(i) where length = 3 group by all),
kept as (select b.* from best b left join held h using (lang, phrase) where more is null or 100 * more < 50 * a),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score::bigint as score from placed join totals using (lang) where rank <= 2000"""

OP13 = """with d as (select doc_id, regexp_replace(coalesce(text, ''), '[ \\x09-\\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, (count(*) over w)::bigint as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)"""
