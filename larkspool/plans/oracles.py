"""DuckDB SQL for the queries of the catalogue, written apart from their plans."""

from __future__ import annotations

from larkspool.functions.text import APOSTROPHES, DASHES, INVISIBLE, QUOTES, SPACES
from larkspool.operators.audit import FOREIGN, LOWER, UPPER
from larkspool.plans.fixtures import MANIFEST, PAIRING

Q = "''"
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
W = r"[\p{L}\p{N}_]"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WHITE}', ' ', 'g'))"


def clean(c: str) -> str:
    t = f"translate(nfc_normalize(coalesce({c}, '')), '{INVISIBLE}', '')"
    t = f"regexp_replace(translate({t}, '{SPACES}', '{' ' * len(SPACES)}'), '{Q}{Q}+', '\"', 'g')"
    odd = QUOTES + APOSTROPHES + DASHES
    plain = '"' * len(QUOTES) + Q * len(APOSTROPHES) + "-" * len(DASHES)
    return squeeze(f"replace(translate({t}, '{odd}', '{plain}'), '…', '...')")


def loop(c: str) -> str:
    toks = f"string_split(lower({squeeze(c)}), ' ')"
    tails = f"list_transform({toks}, lambda t: regexp_extract(t, '({W}+)$', 1))"
    heads = f"list_transform(({toks})[3:], lambda t: regexp_extract(t, '^({W}+)', 1))"
    return f"len(list_filter(list_zip({tails}, ({toks})[2:], {heads}), lambda s: s[1] <> '' and s[1] = s[2] and s[1] = s[3])) > 0"


FRAG_START = rf"regexp_matches({{0}}, '^[\"{Q}(]*\p{{{{Ll}}}}')"
FRAG_END = rf"(regexp_matches({{0}}, '[^.!?\"{Q})][\"{Q})]*$') and not regexp_matches({{0}}, '[.!?][\"{Q})]*$'))"
SPEAKER = "case when speaker_id is null or speaker_id in ('', 'None') then 'channel:' || channel else speaker_id end"
WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{Nl}}\p{{No}}]+'))"
RATE = "case when length(text) > 0 and duration > 0 then length(text) / duration end"


def judged(music: str = "when quality_music_score > 0.7 then 'limit:music'") -> str:
    return f"""m as materialized ({MANIFEST}),
c as materialized (select * replace ({clean("text")} as text), text as raw from m),
j as materialized (select *, {SPEAKER} as speaker_key, text <> coalesce(raw, '') as fixed,
  case when text = '' then 'empty_text' when {WORDS.format("text")} < 2 then 'few_words'
    when duration <= 0 then 'bad_duration' when {loop("text")} then 'asr_loop'
    when not (length(text) / duration between 6 and 25) then 'rate_outlier'
    when review_reasons in ('speaker_mismatch', 'synthetic_suspect') then 'reason:' || review_reasons
    when quality_clip_ratio > 0.02 then 'limit:clip' {music}
    when quality_speech_ratio < 0.7 then 'limit:speech' when quality_dnsmos_ovrl < 2.5 then 'limit:dnsmos'
    when quality_speaker_cosine < 0.55 then 'limit:cosine' end as r0,
  {FRAG_START.format("text")} as frag_start, {FRAG_END.format("text")} as frag_end from c),
j1 as (select *, row_number() over (partition by r0 is null, speaker_key, text, round(duration, 1) order by id) as rn from j),
j2 as materialized (select *, case when r0 is null and rn > 1 then 'duplicate_recording' else r0 end as drop_reason from j1)"""


REPORT = """select metric, n from (
  select coalesce('dropped:' || {0}, 'kept') as metric, count(*) as n from j2 group by 1
  union all select 'fixed:text', count(*) filter (fixed) from j2
  union all select 'fragment:start', count(*) filter (drop_reason is null and frag_start) from j2
  union all select 'fragment:end', count(*) filter (drop_reason is null and frag_end) from j2)"""
FRAGMENT = "case when drop_reason is null and (frag_start or frag_end) then 'fragment' else drop_reason end"

HASH = "md5('{0}|' || {1})"
BUCKET = "case when {0} is not null then len(list_filter({1}, lambda e: e <= {0})) end"
RATE_EDGES, LOUD_EDGES = "[12.216e0, 13.136e0, 13.882e0, 14.735e0]", "[-24.411e0, -20.8e0]"


def bucketed(source: str, rate_edges: str = RATE_EDGES, loud_edges: str = LOUD_EDGES) -> str:
    return f"""(select *, {BUCKET.format("rate", rate_edges)} as rate_bucket, {BUCKET.format("quality_lufs", loud_edges)} as loud_bucket
  from (select *, {RATE} as rate from {source}))"""


EDGES = "e as (select list_transform(quantile_cont(rate, [0.2, 0.4, 0.6, 0.8]), lambda x: round(x, 4)) as re, list_transform(quantile_cont(quality_lufs, [1/3, 2/3]), lambda x: round(x, 4)) as le from (select *, " + RATE + " as rate from m))"

POOL = f"""{judged()}, f as (select quantile_cont(quality_dnsmos_ovrl, 0.1) as df, quantile_cont(quality_speech_ratio, 0.1) as sf from m),
p as materialized (select j2.*, case when not (duration between 2 and 400) then 'duration'
  when quality_dnsmos_ovrl < df then 'dnsmos' when quality_speech_ratio < sf then 'speech'
  when quality_clip_ratio > 0.02 then 'clip' when quality_music_score > 0.6 then 'music' when quality_asr_cer > 0.05 then 'cer' end as reason from j2, f)"""
SUBSET = f"""{POOL}, b as {bucketed("p where reason is null")},
t as (select *, row_number() over (partition by rate_bucket, loud_bucket, speaker_key order by {HASH.format(7, "id")}) as turn from b),
u as (select *, row_number() over (partition by rate_bucket, loud_bucket order by turn, speaker_key) as pick from t),
s as (select *, coalesce(sum(duration) over (order by pick, rate_bucket nulls last, loud_bucket nulls last rows between unbounded preceding and 1 preceding), 0) as before from u),
x as (select * from s where before < 20000)"""

LEVELS = """codes as materialized (select doc_id as id,
  list_transform(range(0, doc_id % 4 + 1), lambda t: (doc_id * 7 + t * 31 + 1) % 4096) as l0,
  list_transform(range(0, (doc_id % 4 + 1) * 2), lambda t: (doc_id * 7 + t * 31 + 2) % 4096) as l1,
  list_transform(range(0, (doc_id % 4 + 1) * 4), lambda t: (doc_id * 7 + t * 31 + 4) % 4096) as l2
  from documents where source <> 'src7'),
flat as materialized (select id, flatten(list_transform(range(0, len(l0)), lambda t: [l0[t + 1], l1[2 * t + 1] + 4096, l1[2 * t + 2] + 4096,
  l2[4 * t + 1] + 8192, l2[4 * t + 2] + 8192, l2[4 * t + 3] + 8192, l2[4 * t + 4] + 8192])) as codes from codes)"""


def uniform(name: str) -> str:
    return f"(('0x' || substr(md5('9|{name}|' || id), 1, 8))::bigint / 4294967296.0e0)"


CONTROL = f"""b as (select *, list_transform(range(0, id % 5 + 1), lambda t: (id * 13 + t * 17) % 4096) as text_ids,
  {FRAG_START.format("text")} as fs, {FRAG_END.format("text")} as fe from {bucketed("m")}),
k as materialized (select *, case when {uniform("rate")} >= 0.15 and rate_bucket is not null then 16395 + rate_bucket else 16400 end as rate_token,
  case when {uniform("loud")} >= 0.15 and loud_bucket is not null then 16401 + loud_bucket else 16404 end as loud_token from b)"""
SEQUENCES = f"""m as materialized ({MANIFEST}), {LEVELS}, {CONTROL},
h as (select k.*, f.codes, r.text_ids as ref_text, list_slice(rf.codes, 1, 819) as ref_codes,
  list_concat(case when k.fs then [16393] else [] end, case when k.fe then [16394] else [] end) as marks
  from k left join flat f on f.id = k.id left join k r on r.id = k.ref_id left join flat rf on rf.id = k.ref_id),
s0 as (select id, 'plain' as kind, 1 as times, case when codes is null then 'miss_audio' end as st, codes,
    flatten([[16384, 16391, rate_token, loud_token], marks, [16387], text_ids, [16388, 16389]]) as prompt from h
  union all select id, 'clone', 2, case when codes is null or ref_codes is null then 'miss_ref' end, codes,
    flatten([[16384, 16392, rate_token, loud_token], marks, [16387], ref_text, text_ids, [16388, 16389], list_transform(ref_codes, lambda c: c + 4096)]) from h where ref_id is not null),
s1 as (select *, flatten([prompt, list_transform(codes, lambda c: c + 4096), [16390, 16385]]) as tokens, len(prompt) as label_start from s0),
s as materialized (select *, len(tokens) as length, case when st is not null then st when len(tokens) > 60 then 'too_long' else 'ok' end as status from s1)"""


def joined(c: str) -> str:
    return f"array_to_string({c}, ',')"


def clamp(slots: str, level: int) -> str:
    return joined(f"flatten(list_transform(range(0, len(f) // 7), lambda t: list_transform({slots}, lambda s: greatest(0, least(4095, f[t * 7 + s] - {level * 4096})))))")


LET = LOWER + UPPER
BARE = rf"regexp_replace(regexp_replace(text, '^{WHITE}', ''), '{WHITE}$', '')"
AUDIT_RULES = {
    ("few_words", "BLOCK"): f"len(regexp_extract_all(text, '[{LET}{FOREIGN}0-9]+')) < 2",
    ("bad_duration", "BLOCK"): "duration <= 0",
    ("repeated_text", "BLOCK"): "rn > 1",
    ("asr_loop", "BLOCK"): loop("text"),
    ("high_cer", "BLOCK"): "quality_asr_cer > 0.15",
    ("doubled_apostrophe", "FIX"): f"contains(text, '{Q}{Q}')",
    ("straight_quote", "FIX"): "contains(text, '\"')",
    ("ellipsis", "FIX"): "contains(text, '…')",
    ("curly_quote", "FIX"): "regexp_matches(text, '[“”‘’«»„]')",
    ("digits", "FIX"): r"regexp_matches(text, '\p{Nd}')",
    ("outer_space", "FIX"): rf"regexp_matches(text, '^{WHITE}|{WHITE}$')",
    ("double_space", "FIX"): rf"regexp_matches(text, '{WHITE[:-1]}{{2,}}')",
    ("not_composed", "FIX"): "nfc_normalize(text) <> text",
    ("odd_character", "FIX"): rf"regexp_matches(text, '[^{LET}{FOREIGN} .,!?:;\-{Q}\"()%&/…\p{{Nd}}\p{{No}}]')",
    ("lower_start", "FIX"): rf"regexp_matches(bare[1], '\p{{L}}') and not regexp_matches(bare[1], '[{UPPER}QWX]')",
    ("no_terminal", "FIX"): f"bare[-1] not in ('.', '!', '?', '\"', '{Q}')",
    ("apostrophe_and_quote", "INFO"): f"regexp_matches(text, '[{LET}]{Q}[{LOWER}]') and contains(text, '{Q}{Q}')",
    ("foreign_letter", "INFO"): f"regexp_matches(text, '[{FOREIGN}]')",
    ("mostly_upper", "INFO"): r"len(regexp_extract_all(text, '\p{Lu}')) > 0.6 * len(regexp_extract_all(text, '\p{L}'))",
    ("clip_ratio", "FIX"): "quality_clip_ratio > 0.01",
    ("speech_ratio", "FIX"): "quality_speech_ratio < 0.5",
    ("music_score", "FIX"): "quality_music_score > 0.5",
    ("dnsmos", "FIX"): "quality_dnsmos_ovrl < 2.5",
    ("speaker_cosine", "FIX"): "quality_speaker_cosine < 0.5",
    ("rate_outlier", "BLOCK"): "duration > 0 and (length(text) / duration < 6 or length(text) / duration > 25)",
    ("ref_missing", "BLOCK"): "ref_id is not null and ref_id not in (select id from m)",
    ("ref_self", "BLOCK"): "ref_id = id",
}
AUDIT = (
    f"with m as materialized ({MANIFEST}), r as materialized (select *, {BARE} as bare, row_number() over (partition by text order by id) as rn from (select * replace (coalesce(text, '') as text) from m)), hits as ("
    + " union all ".join([f"select id, '{n}' as rule, '{s}' as severity from r where bare <> '' and ({c})" for (n, s), c in AUDIT_RULES.items()] + ["select id, 'empty_text', 'BLOCK' from r where bare = ''"])
    + ") select rule, severity, count(*) as n, round(count(*) * 100 / (select count(*) from m), 3) as percent, array_to_string(list_slice(list_sort(list(id)), 1, 5), ',') as examples from hits group by 1, 2"
)
FIELDS = ("quality_clip_ratio", "quality_speech_ratio", "quality_music_score", "quality_dnsmos_ovrl", "quality_speaker_cosine")


def leak(field: str) -> str:
    tr, va = f"(select distinct {field} as v from m where source_split <> 'fr')", f"(select {field} as v, count(*) as n from m where source_split = 'fr' group by 1)"
    both = f"{tr} a join {va} b on a.v is not distinct from b.v"
    return f"select '{field}' as field, (select count(*) from {tr}) as train_values, (select count(*) from {va}) as held_values, (select count(*) from {both}) as shared_values, (select coalesce(sum(b.n), 0)::bigint from {both}) as held_rows_covered, round((select coalesce(sum(b.n), 0) from {both}) * 100 / (select count(*) from m where source_split = 'fr'), 2) as percent"


NEAREST = f"""v as ({PAIRING}), q as materialized (select a.id, b.id as ref_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) as sim
  from v a join v b on a.channel = b.channel and a.source_id <> b.source_id),
top as (select id, ref_id, round(sim, 4) as ref_sim from (select *, row_number() over (partition by id order by sim desc, ref_id) as rn from q) where rn = 1 and round(sim, 4) >= 0.25)"""


def bare(c: str) -> str:
    return squeeze(rf"regexp_replace(lower(nfc_normalize({c})), '\p{{P}}', '', 'g')")


SWAPPED = "translate(text, 'ae.', 'ea')"

SQL: dict[str, str] = {
    "hygiene_report": f"with {judged()} {REPORT.format('drop_reason')}",
    "hygiene_drop_fragments": f"with {judged('')} {REPORT.format(FRAGMENT)}",
    "hygiene_by_source": f"with {judged()} select source_split, count(*) as rows_in, count(*) filter (drop_reason is null) as kept, count(*) filter (drop_reason is not null) as dropped, round(coalesce(sum(duration) filter (drop_reason is null), 0) / 3600, 4) as hours_kept from j2 group by rollup (source_split)",
    "hygiene_kept": f"with {judged()} select id, speaker_key, frag_start, frag_end, md5(text) as text_md5 from j2 where drop_reason is null",
    "clean_text": f"select doc_id, md5({clean('text')}) as text_md5 from documents",
    "fragments": f"select doc_id, {FRAG_START.format('text')} as frag_start, {FRAG_END.format('text')} as frag_end from documents",
    "asr_loop": f"select doc_id, {loop('t')} as loop from (select doc_id, {clean('text')} as t from documents)",
    "text_measures": rf"with m as ({MANIFEST}) select id, {WORDS.format('text')} as words, regexp_matches(text, '\p{{Nd}}') as digits, round({RATE}, 6) as rate, {SPEAKER} as speaker_key from m",
    "parse_ids": r"""with c as (select doc_id, case when doc_id % 5 = 0 then 'clip-' || doc_id else 'source-' || lower(to_hex(doc_id)) || '-' || lpad(n_chars::varchar, 10, '0') || '-' || lpad((n_chars + 1500)::varchar, 10, '0') end as clip from documents),
        p as (select *, regexp_matches(clip, '^source-[0-9a-f]+-\d{10}-\d{10}$') as ok from c)
        select doc_id, case when ok then 'source-' || split_part(clip, '-', 2) end as source, case when ok then split_part(clip, '-', 3)::bigint end as start_ms, case when ok then split_part(clip, '-', 4)::bigint end as end_ms, case when ok then 'source-' || split_part(clip, '-', 2) else clip end as recording from p""",
    "cer": f"select conv_id, turn, case when length(r) > 0 then round(levenshtein(h, r) / length(r)::double, 9) end as cer from (select conv_id, turn, {bare(SWAPPED)} as h, {bare('text')} as r from (select conv_id, turn, regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g') as text from conversations))",
    "prosody_edges": f"with m as ({MANIFEST}), {EDGES} select kind, (unnest(range(0, len(v)))) ::int as edge, unnest(v) as value from (select 'rate' as kind, re as v from e union all select 'loud', le from e)",
    "prosody_buckets": f"with m as materialized ({MANIFEST}), {EDGES} select rate_bucket, loud_bucket, count(*) as n from {bucketed('m, e', 're', 'le')} group by 1, 2",
    "audit_findings": AUDIT,
    "audit_distributions": f"with m as ({MANIFEST}), l as (select 'duration' as field, coalesce(duration, 0) as v from m union all select 'rate', case when duration > 0 then length(text) / duration else 0 end from m where trim(text) <> '' union all "
    + " union all ".join(f"select '{c}', {c} from m where trim(text) <> ''" for c in FIELDS)
    + ") select field, round(avg(v), 4) as mean, round(quantile_cont(v, 0.01), 4) as p1, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.99), 4) as p99 from l where v is not null group by 1",
    "char_inventory": rf"select char, count(*) as n from (select unnest(string_split(text, '')) as char from documents) where char <> '' and (not regexp_matches(char, '[\p{{L}}\p{{N}}]') or char in ({', '.join(repr(c) for c in FOREIGN)})) group by 1",
    "leakage": f"with m as materialized ({MANIFEST}) " + " union all ".join(leak(f) for f in ("source_id", "speaker_id", "channel", "text")),
    "exclude_anti_join": "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where quality = 0)",
    "ref_self_join": f"with m as materialized ({MANIFEST}) select a.id, a.ref_id, round(b.duration, 6) as ref_duration, b.channel as ref_channel, case when b.id is null then 'missing' when a.ref_id = a.id then 'self' else 'ok' end as status from m a left join m b on a.ref_id = b.id where a.ref_id is not null",
    "ref_closure": f"with m as materialized ({MANIFEST}) select id, false as added from m where quality_asr_cer < 0.015 union all select id, true from m where not quality_asr_cer < 0.015 and id in (select ref_id from m where quality_asr_cer < 0.015 and ref_id is not null)",
    "needed_files": f"with m as materialized ({MANIFEST}), n as (select id from m union select ref_id from m where ref_id is not null) select id::varchar as id from n where id not in (select id from m where quality_asr_cer < 0.015)",
    "nearest_in_group": f"with {NEAREST} select * from top",
    "pairing_report": f"with {NEAREST} select (select count(*) from v) as rows_in, count(*) as pairs, round(count(*) * 100 / (select count(*) from v), 2) as percent, round(avg(ref_sim), 4) as mean_sim, round(quantile_cont(ref_sim, 0.1), 4) as p10, round(quantile_cont(ref_sim, 0.5), 4) as p50, round(quantile_cont(ref_sim, 0.9), 4) as p90 from top",
    "subset_reasons": f"with {POOL} select coalesce(reason, 'kept') as reason, count(*) as n from p group by 1",
    "subset_round_robin": f"with {SUBSET} select id, rate_bucket, loud_bucket, pick from x",
    "subset_report": f"with {SUBSET} select rate_bucket, loud_bucket, round(sum(duration) / 3600, 4) as hours, count(distinct speaker_key) as speakers, count(*) as n from x group by 1, 2",
    "hour_budget_greedy": f"""with recursive m as materialized ({MANIFEST}), o as materialized (select id, duration as d, row_number() over (order by {HASH.format(3, "id")}) as k from m),
        w as (select 0::bigint as k, 30000.0e0 as left_, null::bigint as id
          union all select o.k, case when o.d <= w.left_ then w.left_ - o.d else w.left_ end, case when o.d <= w.left_ then o.id end from w join o on o.k = w.k + 1)
        select id from w where id is not null""",
    "evaluation_set": rf"""with m as materialized ({MANIFEST}), u as (select *, {HASH.format(11, "id")} as h from m where duration / 20 between 3 and 15 and review_reasons is null)
        select kind, id, regexp_matches(text, '\p{{Nd}}') as has_digits, ref_id from (
          (select 'plain' as kind, id, text, null as ref_id from u order by h limit 40)
          union all (select 'clone', id, text, ref_id::varchar from u where ref_id in (select id from m) order by h limit 25))""",
    "split_counts": f"with m as ({MANIFEST}) select source_split, count(*) as n from m where source_split in ('de', 'es', 'fr') group by 1",
    "last_row_per_id": "select id, turn, role, text_md5 from (select conv_id as id, turn, role, md5(text) as text_md5, row_number() over (partition by conv_id order by turn desc, role desc, md5(text) desc) as rn from conversations) where rn = 1",
    "flatten_codes": f"with {LEVELS} select id, {joined('codes')} as codes from flat",
    "unflatten_codes": f"with {LEVELS}, g as (select id, list_concat(list_transform(codes, lambda x: x + case when id % 9 = 0 then 5000 else 0 end), [1, 2]) as f from flat) select id, {clamp('[1]', 0)} as l0, {clamp('[2, 3]', 1)} as l1, {clamp('[4, 5, 6, 7]', 2)} as l2 from g",
    "remap_codes": f"with {LEVELS} select id, {joined('flatten(list_transform(l0, lambda x: list_transform([0, 1, 2, 3, 4, 5, 6], lambda s: (x + s) % 4096 + [0, 1, 1, 2, 2, 2, 2][s + 1] * 4096)))')} as codes from codes",
    "build_prompt": f"with {SEQUENCES} select id, kind, label_start, {joined('prompt')} as prompt from s where status = 'ok'",
    "pack_offsets": f"with {SEQUENCES} select id, kind, length, label_start, times, coalesce(sum(length) over (order by kind desc, id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from s where status = 'ok'",
    "pack_stats": f"with {SEQUENCES} select coalesce(sum(times) filter (status = 'ok'), 0)::bigint as examples, count(*) filter (status = 'ok' and kind = 'plain') as plain, coalesce(sum(times) filter (status = 'ok' and kind = 'clone'), 0)::bigint as clone, coalesce(sum(length) filter (status = 'ok'), 0)::bigint as tokens, max(length) filter (status = 'ok') as max_len, round(sum(length * times) filter (status = 'ok') / sum(times) filter (status = 'ok'), 4) as mean_len, (select floor(quantile_cont(length, 0.95))::bigint from s, range(times) where status = 'ok') as p95_len, count(*) filter (status = 'miss_audio') as miss_audio, count(*) filter (status = 'miss_ref') as miss_ref, count(*) filter (status = 'too_long') as too_long from s",
    "packed_problems": f"with {SEQUENCES} select case when id % 10 = 3 then 'bad end' else 'ok' end as problem, count(*) as n from s where status = 'ok' group by 1",
    "collate_batch": f"with {SEQUENCES} select id, {joined('list_transform(range(1, 65), lambda i: case when i <= label_start or i > length then -100 else tokens[i] end)')} as labels, length as mask, 64 as width from s where status = 'ok' and kind = 'plain'",
    "control_dropout": f"with m as materialized ({MANIFEST}), {CONTROL} select rate_token, loud_token, count(*) as n from k group by 1, 2",
    "eval_summary": rf"""with m as ({MANIFEST}), r as (select case when id % 3 = 0 then 'clone' else 'plain' end as kind, regexp_matches(text, '\p{{Nd}}') as has_digits, id % 90 as n_tokens,
        case when id % 8 <> 0 then quality_asr_cer end as cer, case when id % 3 = 0 then quality_speaker_cosine end as spk_cos, quality_dnsmos_ovrl as dnsmos_ovrl, duration as dur_sec from m)
        select kind, has_digits, count(*) as n, count(*) filter (n_tokens < 7) as empty, round(avg(cer), 6) as cer, round(avg(spk_cos), 6) as spk_cos, round(avg(dnsmos_ovrl), 6) as dnsmos_ovrl, round(avg(dur_sec), 6) as dur_sec from r group by grouping sets ((kind), (has_digits), ())""",
    "heldout_turn": """with r as (select (event_id % 12) * 500 as step, abs(value) % 7 + ((event_id % 12) * 500 - 2500) * ((event_id % 12) * 500 - 2500) / 5e6 as nll from events),
        g as (select 'checkpoint-' || step as checkpoint, step, sum(nll) / count(*) as loss from r group by step),
        h as (select *, loss = min(loss) over (order by step) as best_so_far, lead(round(loss, 4)) over (order by step) > round(loss, 4) as rise from g)
        select checkpoint, step, round(loss, 4) as loss, round(exp(loss), 4) as perplexity, best_so_far, coalesce(step = (select min(step) from h where rise), false) as turning_point from h""",
    "quality_floor": f"with m as ({MANIFEST}) select quantile_cont(quality_dnsmos_ovrl, 0.2) as floor from m",
    "reason_algebra": "select doc_id, case doc_id % 4 when 0 then 'a' when 1 then 'b' else '' end as hit, case doc_id % 4 when 0 then 'b,z' when 1 then 'a,z' else 'a,b,z' end as rest from documents",
    "event_dedup_stream": "select distinct user_id, event_type from events",
}

WAVES = "w as materialized (select vec_id as id, list_transform(embedding, lambda v: v::double) as x from embeddings)"
PI = "3.141592653589793e0"


def dft(fn: str) -> str:
    return f"list_sum(list_transform(range(0, len(x)), lambda i: x[i + 1] * {fn}(2 * {PI} * k * i / len(x))))"


# G.711 on 16-bit values s, by the leading bit of the magnitude
U_MAG = "(least(abs(s), 32635) + 132)"
U_EXP = f"(length(bin({U_MAG})) - 8)"
U_BACK = f"((((((({U_MAG} >> ({U_EXP} + 3)) & 15) << 3) + 132) << {U_EXP}) - 132) * case when s < 0 then -1 else 1 end / 32768.0e0)"
A_MAG = "(case when s < 0 then ((-s + 7) // 8) - 1 else s // 8 end)"
A_EXP = f"(case when {A_MAG} > 31 then length(bin({A_MAG})) - 5 else 0 end)"
A_BACK = f"((((({A_MAG} >> greatest({A_EXP}, 1)) & 15) * 16 + case when {A_EXP} > 0 then 264 else 8 end) << greatest({A_EXP} - 1, 0)) * case when s < 0 then -1 else 1 end / 32768.0e0)"


def snr(back: str) -> str:
    return f"round(10 * log10((avg(v * v) + 1e-12) / (avg(({back} - v) * ({back} - v)) + 1e-12)), 4)"


def sinc_sum(down: int, up: int) -> str:
    """The windowed sinc's sum for place j, six lobes wide."""
    cut = min(down, up) * 0.99
    t = f"(((i / {down}.0e0) - (j / {up}.0e0)) * {cut}e0)"
    kernel = f"case when {t} = 0 then 1 else sin({PI} * {t}) / ({PI} * {t}) end * cos({PI} * {t} / 12) ** 2"
    return f"list_sum(list_transform(range(0, len(x)), lambda i: case when abs({t}) < 6 then x[i + 1] * {kernel} else 0 end)) * {cut / down!r}e0"


CLIPS = """c as materialized (select doc_id as id, source as channel, case when doc_id % 3 = 0 then 'drop' else 'keep' end as decision,
  (doc_id % 1000) * 1000 + 250 as start_ms, round(((doc_id % 1000) + 0.25e0 + n_chars / 8.0e0) * 1000)::bigint as end_ms from documents),
v as materialized (select vec_id, embedding from embeddings where vec_id % 10 <> 7)"""
WORDS_TO_999 = """ones as (select unnest(range(0, 10)) as o, unnest(['', 'bir', 'iki', 'üç', 'dört', 'beş', 'altı', 'yedi', 'sekiz', 'dokuz']) as ow),
tens as (select unnest(range(0, 10)) as t, unnest(['', 'on', 'yirmi', 'otuz', 'kırk', 'elli', 'altmış', 'yetmiş', 'seksen', 'doksan']) as tw),
said as materialized (select h.o * 100 + t * 10 + u.o as n, case when h.o + t + u.o = 0 then 'sıfır' else
  trim(regexp_replace(case when h.o = 0 then '' when h.o = 1 then 'yüz' else h.ow || ' yüz' end || ' ' || tw || ' ' || u.ow, ' +', ' ', 'g')) end as words from ones h, tens, ones u)"""
STEPS = "order by {0}) as k"

SQL |= {
    "quality_windows": f"""with {WAVES}, c as materialized (select id, list_slice(x, 1, id % 64 + 1) as x from w),
        s as (select id, x, unnest(case when len(x) < 20 then [0] else range(0, len(x) - 19, 7) end) as s from c)
        select id, s // 7 as "window", 20 as n, round(x[s + 1], 6) as first, round(x[(s + 19) % len(x) + 1], 6) as last from s""",
    "band_energy": f"""with {WAVES}, k as (select id, x, unnest(range(0, 33)) as k from w), e as (select id, k, {dft("cos")} ** 2 + {dft("sin")} ** 2 as p from k)
        select id, round(sum(p) filter (k * 16000 / 64.0e0 > 4000) / sum(p), 6) as above_band from e group by id""",
    "telephony_snr": f"""with {WAVES}, c as (select id, greatest(-1, least(1, unnest(x) * 3)) as v from w), q as (select id, v, round_even(v * 32767, 0)::bigint as s from c)
        select id, {snr(U_BACK)} as snr_u, {snr(A_BACK)} as snr_a from q group by id""",
    "resampled_signal": f"with {WAVES}, j as (select id, x, unnest(range(0, (2 * len(x) + 2) // 3)) as j from w) select id, j as place, round({sinc_sum(3, 2)}, 6) as v from j",
    "intake_defaults": f"with m as ({MANIFEST}) select id, coalesce(speaker_id, '') as speaker_id, case when id % 4 in (1, 2) then source_id else id::varchar end as src from m",
    "pairing_defaults": f"""with m as ({MANIFEST}), d as (select *, case when id % 5 <> 0 then channel else '' end as ch from m)
        select id, ch as channel, case when id % 2 = 0 then source_id else id::varchar end as source_id, case when id % 3 = 0 or speaker_id is null then 'emb-' || ch else speaker_id end as speaker_id from d""",
    "ingest_status": f"""with m as ({MANIFEST}), s as (select duration, case when review_reasons is not null then 'hygiene' when quality_dnsmos_ovrl < 3 then 'dnsmos' else 'kept' end as status from m)
        select status, count(*) as n, round(sum(duration) / 3600, 4) as hours from s group by 1""",
    "new_paths": f"with m as ({MANIFEST}) select id, 'clips/' || id || '.flac' as audio, case when ref_id is null then 'fixed.wav' else 'clips/' || ref_id || '.flac' end as ref_audio from m",
    "packed_lookup": f"with {SEQUENCES} select id, kind, length, label_start, {joined('tokens')} as tokens from s where status = 'ok' and id % 50 = 0",
    "repeated_examples": f"with {SEQUENCES}, r as (select id, kind, unnest(range(1, times + 1)) as copy from s where status = 'ok') select id, kind, copy, md5('4|' || id || '|' || kind || '|' || copy) as order_key from r",
    "generated_codes": f"select doc_id, {joined('list_transform(list_filter(list_transform(range(0, doc_id % 9 + 1), lambda t: (doc_id * 31 + t * 997) % 16448), lambda x: x >= 4096 and x < 16384), lambda x: x - 4096)')} as codes, (n_chars + 2047) // 2048 as frames from documents",
    "shard_number": "select doc_id as id, (row_number() over (order by doc_id) - 1) // 256 as shard from documents",
    "clips_with_vectors": f"with {CLIPS} select vec_id as clip_id, channel, start_ms, end_ms, round(embedding[1]::double, 6) as first from c join v on id = vec_id where decision = 'keep'",
    "vectors_by_time": f"""with {CLIPS}, h as (select distinct channel, start_ms, end_ms from c join v on id = vec_id where decision = 'keep')
        select id as doc_id, channel, exists (select 1 from h where h.channel = c.channel and h.start_ms = c.start_ms and h.end_ms = c.end_ms) as paired from c""",
    "origin_counts": "select lang as source_split, case lang when 'fr' then 0 when 'de' then 1 else 2 end as source_ord, count(*) as n, sum(n_chars)::bigint as chars from documents where lang in ('fr', 'de', 'en') group by 1, 2",
    "loose_numbers": "select doc_id, round(case doc_id % 9 when 0 then n_chars::double when 1 then -n_chars - 0.5e0 when 6 then n_chars * 1e2 when 7 then ('0.' || n_chars)::double end, 9) as value from documents",
    "made_ids": "select doc_id, printf('set-s%04dr%06d', doc_id % 12000, n_chars) as made from documents",
    "spoken_numbers": f"""with {WORDS_TO_999}, d as (select doc_id, doc_id * 37 % 1000 as a, n_chars % 900 + 1 as b from documents), r as (select d.doc_id, p.words as a, q.words as b from d join said p on p.n = d.a join said q on q.n = d.b)
        select doc_id, 'plain' as form, 'Toplam ' || a || ' tane' as spoken from r union all select doc_id, 'share', 'Oran yüzde ' || b || ' oldu' from r
        union all select doc_id, 'money', 'Fiyat ' || a || ' lira oldu' from r union all select doc_id, 'measure', 'Yol ' || b || ' kilometre sürdü' from r""",
    "evaluation_digits": f"with e as ({SQL['evaluation_set']}) select kind, count(*) as n, count(*) filter (has_digits) as with_digits from e group by 1",
    "seconds_budget_batches": f"""with recursive m as materialized ({MANIFEST}), s as (select id, duration, (row_number() over (order by id) - 1) // 256 as shard from m),
        o as materialized (select *, row_number() over (partition by shard {STEPS.format("duration, id")} from s),
        w as (select shard, k, id, duration, 0 as batch, duration as held from o where k = 1 union all
          select o.shard, o.k, o.id, o.duration, w.batch + (w.held >= 2000)::int, case when w.held >= 2000 then 0 else w.held end + o.duration from w join o on o.shard = w.shard and o.k = w.k + 1)
        select id, shard, duration, batch from w""",
    "token_budget_batches": f"""with recursive s as (select doc_id as id, n_chars % 2300 + 300 as length, {HASH.format(1, "doc_id")} as h from documents),
        b as (select *, (row_number() over (order by h, id) - 1) // 448 as block from s),
        o as materialized (select *, row_number() over (partition by block {STEPS.format("length, h, id")} from b),
        w as (select block, k, id, length, 0 as batch, 1 as n from o where k = 1 union all
          select o.block, o.k, o.id, o.length, w.batch + (o.length * (w.n + 1) > 20480)::int, case when o.length * (w.n + 1) > 20480 then 1 else w.n + 1 end from w join o on o.block = w.block and o.k = w.k + 1)
        select id, length, block, batch, md5('1|' || block || '|' || batch) as batch_order from w""",
}
