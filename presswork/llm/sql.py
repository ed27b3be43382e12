"""DuckDB statements of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op10_poisson_mixing"] = """
with sizes as (select coalesce(source, '') as source, sum(length(coalesce(text, ''))) as size from documents group by 1),
totals as (select sum(size) as all_size, count(*)::double as all_weight from sizes),
means as (select source, case when size = 0 then 1.0::double
    else (1.0::double / all_weight) / (size::double / all_size::double) end as whole from sizes, totals),
parted as (select source, greatest(1, ceil(whole / 16.0::double)::int) as draws, whole / greatest(1, ceil(whole / 16.0::double)::int) as mean from means),
terms as (select source, draws, list_transform(range(0, 65), lambda k: exp(k * ln(mean) - mean - lgamma(k + 1.0))) as p from parted),
sums as (select source, draws, list_transform(range(1, 66), lambda i: list_sum(p[1:i])) as cdf from terms),
drawn as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(0, draws)) as draw, draws, cdf
    from documents d join sums s on s.source = coalesce(d.source, '')),
counted as (select * exclude (cdf, draw), len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('mix-1:' ||
    case when draw = 0 then '' else 'draw:' || draw || ':' end || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0)) as n from drawn),
once as (select doc_id, text, lang, source, n_chars, (sum(n) / (count(*) / max(draws)))::bigint as n, count(*) / max(draws) as rows from counted group by all),
each as (select * exclude (rows), unnest(range(0, rows::bigint)) as row from once),
dealt as (select doc_id, text, lang, source, n_chars, unnest(range(0, n))::int as mix_copy from each where n > 0)
select *, md5('mix-1:order:' || coalesce(doc_id::varchar, '') || ':' || mix_copy::varchar) as mix_key from dealt
"""

ORACLES["op4_warc_salvage"] = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
o as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by html) end as owner from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
    case when owner is not null and page_id is distinct from owner then 'revisit' else 'response' end as record_type,
    case when page_id is distinct from owner then owner end as refers_to from o
"""

#: Words of whole texts; ``row`` tells rows of one id apart.
_WORDS = r"""select row_number() over () as row, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents"""

_LEDGER = rf"""
with d as ({_WORDS}),
windows as (select row, unnest(range(1, len(words) - 6)) as start, words from d),
repeated as (select row, start from (select row, start, words[start:start + 7] as run from windows) qualify count(*) over (partition by row, run) > 1),
covered as (select row, count(distinct place) as n from (select row, unnest(range(start, start + 8)) as place from repeated) group by row),
measured as (select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(regexp_extract_all(text, '\p{{L}}')) as n_letters, len(regexp_extract_all(text, '\p{{Lu}}')) as n_upper
    from d left join covered using (row)),
ledger as (select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
    [n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > 3 * n_words, n_letters >= 40 and 10 * n_upper > 6 * n_letters,
    word_chars < 2 * n_words or word_chars > 25 * n_words, len(lines) >= 4 and 2 * (len(lines) - len(list_distinct(lines))) > len(lines)] as fails from measured)
"""

ORACLES["op3_quality_rules"] = f"""{_LEDGER}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] or fails[2] as base_failed, not list_bool_or(fails) as kept,
    list_sum(list_transform(fails, lambda f, i: if(f, 1 << (i - 1), 0)))::bigint as rule_bits from ledger
"""

_RULES = ("few_words", "repeated_windows", "symbols", "shouting", "odd_word_length", "repeated_lines")
ORACLES["quality_ablations"] = f"""{_LEDGER},
judged as (select fails, len(list_filter(fails, lambda f: f)) as n from ledger),
rules as (select unnest(range(1, {len(_RULES) + 1})) as i, unnest([{", ".join(f"'{r}'" for r in _RULES)}]) as rule)
select rule, count(*) filter (fails[i]) as n_failed, count(*) filter (fails[i] and n = 1) as n_failed_alone,
    count(*) filter (n = 0 or (fails[i] and n = 1)) as n_kept_without from judged right join rules on true group by rule
"""

ORACLES["op8_relative_parsing"] = f"""
with d as ({_WORDS}),
windows as (select row, doc_id, unnest(range(1, len(words) - 11)) as start, words from d),
found as (select row, start, doc_id > min(doc_id) over (partition by run) as later
    from (select row, doc_id, start, array_to_string(words[start:start + 12], ' ') as run from windows)),
covered as (select distinct row, unnest(range(start, start + 13)) as place from found where later),
placed as (select row, unnest(range(1, len(words) + 1)) as place, unnest(words) as word from d),
kept as (select row, count(*) as n, string_agg(word, ' ' order by place) as text from placed anti join covered using (row, place) group by row)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (row)
"""

#: Conversations damaged by CRC-32, which is spelled out byte by byte; then the least audits, row by row from the front.
ORACLES["op13_conversation_repair"] = r"""
with recursive keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hashed as (select *, xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::bigint),
    lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295)) % 20 as kind from keyed),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case kind when 3 then 2 else 1 end)) as copy from hashed where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last, left(role, 1) as initial from damaged),
faulty as (select *, case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault,
    lag(initial) over (partition by conv_id order by place) as before, case when initial in ('s', 'u', 'a') then initial else 'o' end as known from placed),
spelled as (select *, case when fault in ('blank', 'duplicate') then '-' when fault = 'truncated' then upper(known) else known end as letter from faulty),
found as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, string_agg(letter, '' order by place) as signature from spelled group by conv_id),
states as (select unnest([0, 1, 2, 3]) as state, unnest(['u', 'u', 'a', 'u']) as waits, unnest([2, 2, 3, 2]) as goes),
letters as (select unnest(['-', 's', 'u', 'a', 'o', 'S', 'U', 'A', 'O']) as letter),
inserts as (select state, state as now, 0 as cost, '' as edits from states union all select state, goes, 5, 'I' from states
    union all select a.state, b.goes, 10, 'II' from states a join states b on b.state = a.goes),
edits as (select state, letter, state as now, 2 as cost, 'D' as edit from states, letters
    union all select state, letter, goes, case when letter = upper(letter) then 6 else 1 end, 'R' from states, letters where letter <> '-'
    union all select state, letter, goes, case when letter = upper(letter) then 5 else 0 end, 'K' from states, letters where lower(letter) = waits
    union all select 0, letter, 1, case when letter = upper(letter) then 5 else 0 end, 'K' from letters where lower(letter) = 's'),
steps as (select i.state, e.letter, e.now, i.cost + e.cost as cost, i.edits || e.edit as edits from inserts i join edits e on e.state = i.now),
walked(signature, place, state, best) as (select distinct signature, 0, 0, {'cost': 0, 'audit': ''} from found where signature is not null
    union all select w.signature, w.place + 1, s.now, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.edits}) from walked w
    join steps s on s.state = w.state and s.letter = w.signature[w.place + 1] where w.place < length(w.signature) group by 1, 2, 3),
ended as (select signature, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.edits}) as best from walked w join inserts i on i.state = w.state
    where w.place = length(w.signature) and i.now in (0, 3) group by 1),
planned as (select found.*, best.cost, best.audit from found join ended using (signature)),
edited as (select conv_id, step, audit[step] as edit, step - length(replace(audit[:step], 'I', '')) as added from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as step from planned)),
kept as (select e.conv_id, e.step, edit, initial, role, text, row_number() over (partition by e.conv_id order by e.step) as nth from edited e
    left join placed p on p.conv_id is not distinct from e.conv_id and p.place = e.step - e.added and edit <> 'I' where edit <> 'D'),
named as (select *, (first_value(edit = 'K' and initial = 's') over (partition by conv_id order by nth))::int as shift from kept),
repaired as (select conv_id, string_agg(case when edit = 'K' then role when (nth - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by nth) as whole from named group by conv_id),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256 from every
left join planned on planned.conv_id is not distinct from every.conv_id left join repaired on repaired.conv_id is not distinct from every.conv_id
"""
