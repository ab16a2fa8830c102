"""DuckDB SQL that expresses the queries independently: one regular expression per lexicon term."""

from __future__ import annotations

import re

from inkstone.functions import lexicons as L
from inkstone.functions import text as T
from inkstone.functions import urls as U
from inkstone.operators import compose as C
from inkstone.operators import images as I
from inkstone.sources.fixtures import ARTICLES_SQL

X = L.FIXTURE
NORM = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"
HYPHENS = lambda c: f"trim(regexp_replace(replace(lower(coalesce({c}, '')), '-', ' '), '\\s+', ' ', 'g'))"
WORDS = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(column: str, term: str) -> str:
    return f"regexp_matches({column}, {quoted(r'(^|[^\p{L}\p{N}_])' + re.escape(term).replace(chr(92) + ' ', ' ').replace(chr(92) + '-', '-') + r'($|[^\p{L}\p{N}_])')})"


def total(column: str, weights: dict[str, int], times: int = 1) -> str:
    return "(" + " + ".join(f"case when {hit(column, t)} then {w * times} else 0 end" for t, w in weights.items()) + ")"


def any_of(column: str, terms) -> str:
    return "(" + " or ".join(hit(column, t) for t in terms) + ")"


def found(column: str, terms) -> str:
    return "list_filter([" + ", ".join(f"case when {hit(column, t)} then {quoted(t)} end" for t in terms) + "], lambda x: x is not null)"


def strings(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


_REGION = {**X.states, **X.entities, **X.region}
_BASE = f"""{ARTICLES_SQL},
n as (select *, {NORM('title')} as t, {NORM('content')} as c, {HYPHENS('title')} as p from articles),
m as (select *, trim(t || ' ' || t || ' ' || c) as a from n),
lex as (select *, least(100, {total('a', X.states)} + {total('a', X.entities)} + {total('a', X.region)} + {total('t', X.states, 2)} + {total('t', X.entities, 2)} + {total('t', X.region, 2)}) as region_score,
  {found('a', _REGION)} as region_list, {any_of('t', _REGION)} as title_region,
  {", ".join(f"{total('a', X.themes[k])} as {name}" for k, name in zip(L.THEMES, ('security_score', 'development_score', 'society_score', 'sports_score'), strict=True))},
  {total('a', X.irrelevant)} as irrelevant_score from m),
th as (select *, {", ".join(f"{total('t', X.themes[k], 4)} + {total('c', X.themes[k])} + {total('t', dict.fromkeys(X.boosts[k], 5))} as th{j}" for j, k in enumerate(L.THEMES))} from lex),
best as (select *, greatest(th0, th1, th2, th3) as theme_max, case when greatest(th0, th1, th2, th3) < 10 then '{L.REGIONAL}'
  {" ".join(f"when th{j} = greatest(th0, th1, th2, th3) then {quoted(k)}" for j, k in enumerate(L.THEMES))} end as theme from th),
op as (select *, region_score > 0 and (theme not in ('{L.SPORTS}', '{L.SECURITY}') or title_region or region_score >= 8) as is_open from best),
sc as (select *, case when is_open then least(100, greatest(0, round_even((0.60 * least(100, region_score) + 0.40 * least(100, 2 * theme_max) - least(15, irrelevant_score))::double, 0)::int)) else 0 end as relevance_score from op),
rl as (select *, is_open and ((region_score >= 8 and theme_max >= 5 and relevance_score >= 20) or (title_region and region_score >= 8 and theme_max >= 5 and irrelevant_score < 10)) as relevant from sc),
rel as (select *, case when relevant then theme else '{L.NOT_RELEVANT}' end as category, case when is_open then array_to_string(region_list[1:6], ', ') else '' end as reason_terms from rl)"""
_TITLE_FIRST = "case " + " ".join(f"when {any_of('p', dict.fromkeys(t.replace('-', ' ') for t in X.titles[k]))} then {quoted(k)}" for k in (L.SPORTS, L.SECURITY, L.DEVELOPMENT, L.SOCIETY, L.REGIONAL))
_TITLE_FIRST += f" when category in {strings(L.CATEGORY_ORDER)} then category else '{L.REGIONAL}' end"
_GENERIC = f"({any_of('p', X.generic_terms)} or " + " or ".join(f"starts_with(p, {quoted(s)})" for s in X.generic_starts) + ")"
_EDITORIAL = f"{_BASE}, ed as (select *, case when (t = '' and c = '') or {_GENERIC} or not relevant then '{L.NOT_RELEVANT}' else {_TITLE_FIRST} end as editorial_category from rel)"
_SECONDS = "(epoch(timestamp '2026-10-05') - epoch(least(published_date, timestamp '2026-10-05')))"
_LINES = "len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: trim(x, ' ') <> ''))"
_SUBS = " + ".join(f"case when contains(lower(coalesce(title, '') || ' ' || coalesce(content, '')), {quoted(s)}) then 1 else 0 end" for s in X.security_hits)
_SCORED = f"""{_BASE}, parts as (select *, round(region_score::double, 2) as region_part, round(least(100.0::double, greatest(security_score, development_score, society_score, sports_score)::double / 50 * 100), 2) as theme_part,
  round(least(100, least(100, 15 * ({_SUBS})) + case when category = '{L.SECURITY}' then 40 else 0 end)::double, 2) as security_part,
  round(case when published_date is null or published_date < timestamp '2026-09-01' then 0.0::double else greatest(0.0::double, least(100.0::double, 100.0::double - floor({_SECONDS} / 86400) / 34::double * 100.0::double)) end, 2) as freshness_part,
  case when coalesce(source, '') = '' then 0 {" ".join(f"when source = {quoted(s)} then {w}" for s, w in X.source_scores.items())} else {L.DEFAULT_SOURCE_SCORE} end::double as source_part,
  case when length(coalesce(content, '')) < 300 then 0 else
    (case when length(coalesce(title, '')) >= 30 then 20 when length(coalesce(title, '')) >= 15 then 10 else 0 end)
    + (case when length(content) >= 3000 then 40 when length(content) >= 1500 then 30 when length(content) >= 800 then 20 else 10 end)
    + (case when {_LINES} >= 8 then 20 when {_LINES} >= 5 then 15 when {_LINES} >= 3 then 10 else 0 end) end::double as content_part from rel),
scored as (select *, round(0.30::decimal(3,2) * region_part::decimal(7,2) + 0.25::decimal(3,2) * theme_part::decimal(7,2) + 0.15::decimal(3,2) * security_part::decimal(7,2) + 0.10::decimal(3,2) * freshness_part::decimal(7,2) + 0.10::decimal(3,2) * source_part::decimal(7,2) + 0.10::decimal(3,2) * content_part::decimal(7,2), 2)::double as article_score from parts)"""
_RELEVANT = f"{_SCORED}, relevants as (select * from scored where category <> '{L.NOT_RELEVANT}')"
_ERRORS = "list_filter([" + ", ".join(f"case when {c} is null or {c}::varchar = '' then 'missing {c}' end" for c in ("title", "url", "source", "published_date"))
_ERRORS += ", case when content is null or content = '' then 'missing content' when length(content) < 300 then 'content too short' end], lambda x: x is not null)"
_IN = "coalesce(published_date between timestamp '2026-09-01' and timestamp '2026-10-05', false)"
_HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def is_article(u: str) -> str:
    p = f"lower({_PATH.format(u=u)})"
    return f"({p} not in ('', '/') and not ({' or '.join(f'starts_with({p}, {quoted(x)})' for x in U.EXCLUDED_PATHS)}) and len(string_split(trim({p}, '/'), '/')) >= 2)"


def norm_shares(column: str) -> str:
    return f"{_RELEVANT} select {column} as name, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as percent from relevants where {column} is not null group by {column}"


SENTENCES = lambda c: f"list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: x <> '')"
WORD_COUNT = lambda c: f"len(regexp_extract_all(coalesce({c}, ''), '\\S+'))"
CITED = lambda c: f"list_sort(list_distinct(list_transform(regexp_extract_all({c}, '(?i)\\[Source\\s+(\\d+)\\]', 1), lambda x: x::int)))"
NUMBERS = lambda c: f"list_transform(regexp_extract_all({c}, {quoted(T.NUMBER)}), lambda x: lower(trim(x, ' ')))"
_DAY = "regexp_replace(replace(trim(x, ' '), ',', ''), '\\s+', ' ', 'g')"
_PARSED = "coalesce(" + ", ".join(f"try_strptime({_DAY}, '{f}')" for f in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%m/%d/%Y", "%m-%d-%Y", "%B %d %Y", "%b %d %Y", "%d %B %Y", "%d %b %Y")) + ")"
_PARSED = f"case when regexp_matches(x, '\\d{{4}}') then {_PARSED} end"


def dates(c: str) -> str:
    raw = f"list_filter(regexp_extract_all({c}, {quoted(T.DATE)}), lambda x: ({_PARSED}) is not null)"
    rest = f"list_reduce(list_concat([{c}], {raw}), lambda t, x: replace(t, x, ' '))"
    return f"list_sort(list_distinct(list_concat(list_transform({raw}, lambda x: strftime({_PARSED}, '%Y-%m-%d')), regexp_extract_all({rest}, '\\b(\\d{{4}})\\b', 1))))"


ENTITIES = lambda c: f"list_sort(list_filter([{', '.join(map(quoted, X.security_hits))}], lambda t: contains(lower({c}), t)))"
VECTOR = lambda c: "[" + ", ".join(f"(length(lower({c})) - length(replace(lower({c}), '{chr(97 + k)}', '')))::double" for k in range(26)) + "]"
_WC, _SENT = WORD_COUNT("content"), SENTENCES("content")
_LEADING = lambda x: f"regexp_extract({x}, '(\\d+(?:\\.\\d+)?)', 1)"
_MADE = f"""{ARTICLES_SQL}, dd as (select id, title, content, {_SENT} as s, case when id % 7 = 0 then '' else ' [Source 1]' end as cite from articles), d as (select * from dd where len(s) >= 3),
made as (select id as draft_id, s[1] || ' ' || s[2] || case when id % 5 = 0 then ' 4711 km.' else '' end || cite || chr(10) || case when id % 3 = 0 then 'Nothing of this kind was ever written in any of the sources.' else s[3] end
  || case when id % 4 = 0 then ' [source 2]' else cite end as article, case when id % 4 = 0 then [1, 2] else [1] end as source_ids from d),
src as (select id as draft_id, 1 as source_id, title, content from d union all select id + 1, 2, title, content from d)"""
_UNKNOWN = lambda facts, known: f"list_filter({facts}, lambda f: not (list_contains(list_transform({known}, lambda k: {NORM('k')}), {NORM('f')}) or ({_LEADING('f')} <> '' and list_contains(list_transform({known}, lambda k: {_LEADING('k')}), {_LEADING('f')}))))"
_JUDGED = f"""{_MADE}, c1 as (select *, {CITED('article')} as cits from made),
c2 as (select *, list_filter(cits, lambda x: list_contains(source_ids, x)) as ok, list_filter(cits, lambda x: not list_contains(source_ids, x)) as bad from c1),
ln as (select draft_id, ok, bad, unnest([0, 1]) as paragraph, unnest(string_split(article, chr(10))) as line from c2),
pl as (select *, trim(regexp_replace(line, '(?i)\\[Source\\s+(\\d+)\\]', '', 'g'), ' ') as plain, {CITED('line')} as own from ln),
ct as (select *, case when len(own) > 0 then own when len(ok) = 1 and len(bad) = 0 then ok else [] end as cited from pl where plain <> ''),
cl as (select *, case when len(cited) = 0 then [plain] else {SENTENCES('plain')} end as parts from ct where len(cited) > 0 or {WORD_COUNT('plain')} >= 8),
cs as (select draft_id, paragraph, cited, unnest(range(len(parts)))::int as sentence, unnest(parts) as claim from cl),
cx as (select draft_id, paragraph, sentence, claim, {VECTOR('claim')} as v, unnest(case when len(cited) = 0 then [null::int] else cited end) as source_id from cs),
sf as (select draft_id, source_id, {NUMBERS('content')} as nums, {dates('content')} as days, {ENTITIES('content')} as ents from src),
st as (select draft_id, source_id, unnest({SENTENCES('content')}) as t from src), sv as (select draft_id, source_id, {VECTOR('t')} as w from st),
sim as (select draft_id, paragraph, sentence, source_id, max(case when list_dot_product(v, v) > 0 and list_dot_product(w, w) > 0 then list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))) else 0 end) as m
  from cx join sv using (draft_id, source_id) group by all),
jd as (select cx.draft_id, cx.paragraph, cx.sentence, cx.source_id, round(coalesce(sim.m, 0), 6) as similarity, case when cx.source_id is null then ['no citation'] when sf.nums is null then ['source not available'] else
  list_concat(list_concat(list_transform({_UNKNOWN(NUMBERS('claim'), 'sf.nums')}, lambda x: 'number: ' || x), list_transform({_UNKNOWN(dates('claim'), 'sf.days')}, lambda x: 'date: ' || x)),
    list_transform(list_filter({ENTITIES('claim')}, lambda x: not list_contains(sf.ents, x)), lambda x: 'entity: ' || x)) end as errs
  from cx left join sf using (draft_id, source_id) left join sim on cx.draft_id = sim.draft_id and cx.paragraph = sim.paragraph and cx.sentence = sim.sentence and cx.source_id = sim.source_id),
judged as (select *, len(errs) = 0 and similarity >= 0.45 as supported from jd)"""
_VERDICTS = f"""{_JUDGED}, cn as (select draft_id, count(*) as n, count(*) filter (where supported) as good, count(*) filter (where list_contains(errs, 'no citation')) as bare from judged group by draft_id),
vr as (select m.draft_id, m.article, m.source_ids, list_filter(m.source_ids, lambda x: not list_contains({CITED('m.article')}, x)) as missing, list_filter({CITED('m.article')}, lambda x: not list_contains(m.source_ids, x)) as invalid,
  coalesce(n, 0) as n_claims, coalesce(good, 0) as n_supported, coalesce(bare, 0) as n_uncited from made m left join cn on m.draft_id = cn.draft_id),
verdicts as (select *, case when n_claims > 0 then round(100.0::double * n_supported / n_claims, 2) else 0.0 end as grounding_score, n_claims > 0 and n_supported = n_claims and len(invalid) = 0 and n_uncited = 0 as grounded from vr),
status as (select *, case when list_sort(list_distinct(source_ids)) <> {CITED('article')} then 'citation_failed' when not grounded then 'grounding_failed' else 'success' end as status from verdicts)"""
_KEYS = f"list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda w: length(w) >= 3 and w not in {strings(L.STOPWORDS)})"
_DOMAIN = "regexp_replace(" + _HOST.format(u="url") + ", '^www\\.', '')"
_IMG = "(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || case page_id % 4 when 0 then '/images/Photo-' || page_id || '.JPG?w=300&v=' || page_id || '#x' when 1 then '/static/logo.png' when 2 then '/media/' || page_id else '/a/' || page_id || '-jpg.webp?b=2&a=1' end)"

_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_TOKENS = lambda c: f"regexp_extract_all({c}, '\\S+')"
_LONGEST = lambda words: f"list_filter([{', '.join(quoted(w) for w in sorted(words, key=lambda w: (-len(w), w)))}], lambda x: contains(low, x))"
_FIRSTS = lambda c: f"list_transform(list_filter(list_zip({c}, range(1, len({c}) + 1)), lambda z: list_position({c}, z[1]) = z[2]), lambda z: z[1])"


def _CLEANED(c: str) -> str:  # noqa: N802
    out = f"trim(regexp_replace(trim(regexp_replace({c}, '\\s', ' ', 'g'), ' '), {quoted('(?i)^(' + '|'.join(T.REQUEST_STARTS) + ')')}, ''), ' ')"
    for end in T.REQUEST_ENDS:
        out = f"regexp_replace({out}, {quoted('(?i)' + end)}, '')"
    return f"regexp_replace({out}, '^[ .,:;]+|[ .,:;]+$', '', 'g')"


def _chunks(rows: str) -> str:
    """CTEs up to chunked (id, cs, k): the chunks of rows (id, content), k their places."""
    return f"""p as (select id, id % 3 = 0 as img, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') as ps from ({rows})),
      q as (select id, ps, {_TOKENS('ps[1]')} as w, case when img then {C.OPENER_IMAGE} else {C.OPENER_PLAIN} end as lim from p where len(ps) > 0),
      r as (select id, case when len(ps) > 1 then array_to_string(w[1:lim], ' ') end as opener, case when len(ps) = 1 then ps else list_concat(case when len(w) > lim then [array_to_string(w[lim + 1:], ' ')] else []::varchar[] end, ps[2:]) end as rest from q),
      s as (select id, opener, flatten(list_transform(rest, lambda x: case when len({_TOKENS('x')}) > {C.CONTINUATION} then list_transform(range(0, len({_TOKENS('x')}), {C.CONTINUATION}), lambda k: array_to_string(({_TOKENS('x')})[k + 1 : k + {C.CONTINUATION}], ' ')) else [x] end)) as pieces from r),
      f as (select id, opener, list_reduce(list_concat([{{'done': []::varchar[], 'cur': null::varchar, 'n': 0::bigint}}], list_transform(pieces, lambda x: {{'done': []::varchar[], 'cur': x, 'n': len({_TOKENS('x')})::bigint}})),
        lambda a, b: case when a.cur is not null and a.n + b.n <= {C.CONTINUATION} then {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur, 'n': a.n + b.n}} else {{'done': case when a.cur is null then a.done else list_append(a.done, a.cur) end, 'cur': b.cur, 'n': b.n}} end) as st from s),
      g as (select id, list_concat(case when opener is null then []::varchar[] else [opener] end, list_append(st.done, st.cur)) as cs from f),
      chunked as (select id, cs, unnest(range(1, len(cs) + 1)) as k from g)"""


def _fixed(block: int, kinds) -> str:
    return f"select {block} as block, 0 as section, '' as category, 0 as position, unnest(range({len(kinds)}))::int as part, null::bigint as id, unnest([{', '.join(map(quoted, kinds))}]) as kind"


_ORDER = f"coalesce(list_position([{', '.join(map(quoted, L.CATEGORY_ORDER))}], category), 99)"
_PLAN = f"""with {_RELEVANT}, chosen as (select id, category, content from relevants order by coalesce(article_score, 0) desc, id limit 11), {_chunks('select id, content from chosen')},
  nums as (select category, row_number() over (order by {_ORDER}, min(id))::int as section from chosen group by category),
  raw as ({_fixed(0, C.FRONT)} union all select 1, section, category, 0, 0, null, 'section' from nums union all select 1, section, chosen.category, id::int, k::int, id, 'article' from chunked join chosen using (id) join nums on nums.category = chosen.category
    union all {_fixed(2, C.ANALYTICS)} union all {_fixed(3, C.BACK)}),
  placed as (select *, row_number() over (order by block, section, position, part, id, kind)::int as pn, count(*) over ()::int as n from raw),
  plan as (select (case when n < {C.PAGES} and pn > n - {C.TAIL} then pn + {C.PAGES} - n else pn end)::int as page_number, kind, category, id, part from placed where pn <= {C.PAGES}
    union all select ((select max(n) from placed) - {C.TAIL} + 1 + i)::int, ([{', '.join(map(quoted, C.SUPPORT))}])[i % {len(C.SUPPORT)} + 1], '', null, (i // {len(C.SUPPORT)})::int from (select unnest(range({C.PAGES} - least({C.PAGES}, (select max(n) from placed)))) as i))"""


_FINDINGS = f"""with {ARTICLES_SQL}, p as (select id + 1 as page_number, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') as t, source = 'src3' and length(content) % 2 = 1 as failed from articles),
  f as (select case when failed then 'error' else 'warning' end as severity, case when failed then 'unreadable' else 'little text' end as check_name, page_number, case when failed then 'no text layer' else length(t) || ' characters' end as detail from p where failed or length(t) < 300
    union all select 'error', 'page count', null, 'expected {C.PAGES}, found ' || count(*) from p having count(*) <> {C.PAGES}
    union all select 'warning', 'marker', null, m from (values ('the'), ('zzzz no such marker')) v(m) where not exists (select 1 from p where not failed and contains(t, m)))"""

SQL: dict[str, str] = {
    "validate_articles": f"with {ARTICLES_SQL} select id, array_to_string({_ERRORS}, ',') as errors, len({_ERRORS}) = 0 as valid from articles",
    "date_window": f"with {ARTICLES_SQL} select id, {_IN} as inside from articles",
    "ingest_funnel": f"""with {ARTICLES_SQL}, k as (select distinct url as known from articles where id % 20 = 0), g as (select a.*, case when len({_ERRORS}) > 0 then 'invalid' when not {_IN} then 'outside_date_range' when k.known is not null then 'duplicate' end as gate
      from articles a left join k on a.url = k.known), h as (select coalesce(gate, case when row_number() over (partition by url, gate is null order by id) > 1 then 'duplicate' else 'saved' end) as gate from g) select gate, count(*) as n from h group by gate""",
    "insert_if_absent": f"with {ARTICLES_SQL} select min(id) as id, url from articles where url not in (select url from articles where id % 20 = 0) group by url",
    "article_exists": f"with {ARTICLES_SQL} select id, url from articles where url in (select url from articles where id % 20 = 0)",
    "delete_by_predicate": f"with {ARTICLES_SQL} select id from articles where not coalesce(title = (select min(title) from articles), false)",
    "text_forms": f"with {ARTICLES_SQL} select id, md5({NORM('content')}) as normal, md5({HYPHENS('content')}) as hyphens, md5({WORDS('content')}) as words, {_WC}::int as n from articles",
    "markup_strip": f"""with {ARTICLES_SQL}, s as (select id, '**' || title || '**  and  [Source ' || id || '] more , text [source 2].' as raw from articles)
      select id, trim(regexp_replace(regexp_replace(regexp_replace(replace(raw, '**', ''), '(?i)\\[Source\\s+\\d+\\]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' +([,.!?;:])', '\\1', 'g'), ' ') as plain from s""",
    "lexicon_score": f"with {_BASE} select id, region_score, title_region, array_to_string(region_list, ',') as region_terms, security_score, development_score, society_score, sports_score, irrelevant_score from lex",
    "theme_classify": f"with {_BASE} select id, [th0, th1, th2, th3]::varchar as themes, theme_max, theme from best",
    "relevance": f"with {_BASE} select id, relevance_score, relevant, category, reason_terms from rel",
    "generic_content": f"with {_BASE} select id, {_GENERIC} as generic from n",
    "title_first_category": f"with {_BASE} select id, {_TITLE_FIRST} as category from rel",
    "editorial_category": f"with {_EDITORIAL} select id, editorial_category from ed",
    "editorial_category_counts": f"with {_EDITORIAL} select c.category, count(ed.id) as n from (select unnest([{', '.join(map(quoted, (*L.CATEGORY_ORDER, L.NOT_RELEVANT)))}]) as category) c left join ed on ed.editorial_category = c.category group by c.category",
    "score_components": f"with {_SCORED} select id, region_part, theme_part, security_part, freshness_part, source_part, content_part from scored",
    "composite_score": f"with {_SCORED} select id, category, article_score from scored",
    "persisted_scores": f"with {_SCORED} select id, " + ", ".join(f"case when relevant then round_even({c}, 0)::int else 0 end as {c}" for c in ("article_score", "theme_part", "security_part", "freshness_part", "source_part", "content_part")) + " from scored",
    "article_rank": f"with {_SCORED} select s.id, r.rank::bigint as rank from scored s left join (select id, row_number() over (order by article_score desc, published_date desc nulls last, id) as rank from scored where relevance_score > 0 and article_score > 0) r on s.id = r.id",
    "top_articles": f"with {_RELEVANT} select id, article_score from relevants order by coalesce(article_score, 0) desc, id limit 10",
    "stats_overall": f"with {_RELEVANT} select count(*) as total, coalesce(round(avg(coalesce(article_score, 0)), 2), 0) as avg_article_score, coalesce(round(avg(relevance_score), 2), 0) as avg_relevance_score, coalesce(round(avg(theme_max), 2), 0) as avg_theme_max, strftime(min(published_date), '%Y-%m-%d') as first_date, strftime(max(published_date), '%Y-%m-%d') as last_date from relevants",
    "stats_category": "with " + norm_shares("category"),
    "stats_source": "with " + norm_shares("source"),
    "stats_daily": f"with {_RELEVANT} select strftime(published_date, '%Y-%m-%d') as day, count(*) as n from relevants group by 1",
    "stats_entity_group": f"with {_BASE}, g as (select unnest(list_filter([{', '.join(f'case when {any_of("a", ts)} then {quoted(g)} end' for g, ts in X.groups.items())}], lambda x: x is not null)) as name from m) select name, count(*) as n from g group by name",
    "source_appendix": f"with {ARTICLES_SQL} select case when trim(coalesce(source, '')) = '' then 'Unknown Source' else trim(source) end as source, count(*) as n from articles group by 1",
    "category_lines": f"with {_RELEVANT} select list_position([{', '.join(map(quoted, L.CATEGORY_ORDER))}], category)::int - 1 as place, category || ': ' || count(*) as line from relevants group by category",
    "word_totals": f"with {ARTICLES_SQL} select sum({_WC})::bigint as words, round_even(avg({_WC}), 0)::bigint as mean_words from articles",
    "edition_metadata": f"with {ARTICLES_SQL} select strftime(min(published_date), '%Y-%m-%d') as first_date, strftime(max(published_date), '%Y-%m-%d') as last_date, count(*) as articles, count(distinct nullif(source, '')) as sources from articles",
    "sentences": f"with {ARTICLES_SQL} select id, len({_SENT})::int as n, md5(array_to_string({_SENT}, '|')) as joined from articles",
    "keywords": f"with {ARTICLES_SQL} select id, array_to_string({_KEYS}, ' ') as keywords from articles",
    "citations": f"with {ARTICLES_SQL}, s as (select id, title || ' [Source ' || id % 7 || '] and [source  ' || id % 5 || '] [Source x]' as raw from articles) select id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(raw, '(?i)\\[Source\\s+(\\d+)\\]', 1), lambda x: x::int))), ',') as cited, trim(regexp_replace(raw, '(?i)\\[Source\\s+\\d+\\]', '', 'g'), ' ') as plain from s",
    "entities": f"with {ARTICLES_SQL} select id, array_to_string(list_sort(list_filter([{', '.join(map(quoted, X.security_hits))}], lambda t: contains(lower(content), t))), ',') as entities from articles",
    "citation_sets": f"with {ARTICLES_SQL}, s as (select id, [id % 3, id % 4, 9] as declared, list_distinct([id % 4, id % 5]) as cited from articles) select id, list_sort(list_filter(list_distinct(declared), lambda x: not list_contains(cited, x)))::varchar as missing, list_sort(list_filter(cited, lambda x: not list_contains(declared, x)))::varchar as invalid, list_sort(list_distinct(declared)) = list_sort(cited) as agree from s",
    "url_discovery": f"""with pg as (select page_id, url, '<a class="x" href="/news/story-' || page_id || '?ref=home"><a class="x" href="/news/story-' || page_id || '#top"><a class="x" href="/category/x/' || page_id || '"><a class="x" href="https://other.example.org/news/x"><a class="x" href="/a/b/' || page_id || '"><a class="x" href="/news/plain-' || page_id || '"><a class="x" href="/news/that&this-' || page_id || '">' || html as html from pages),
      h as (select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) as href from pg), a as (select page_id, url, case when starts_with(trim(href), '/') then regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || trim(href) else trim(href) end as link from h),
      c as (select page_id, url, regexp_replace(link, '[?#].*$', '') as link from a) select distinct page_id, link from c where {_HOST.format(u='link')} = {_HOST.format(u='url')} and {is_article('link')}""",
    "url_parts": f"select page_id, {_HOST.format(u='url')} as host, {_DOMAIN} as domain, {_PATH.format(u='url')} as path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query, {is_article('url')} as article from pages",
    "domain_tier": f"select page_id, case when {_DOMAIN} = '' or {' or '.join(f'contains({_DOMAIN}, {quoted(b)})' for b in U.BLOCKED_DOMAINS)} then 0 when {_DOMAIN} in {strings(U.HIGH_DOMAINS)} then 3 when {_DOMAIN} in {strings(U.MEDIUM_DOMAINS)} then 2 else 1 end as tier from pages",
    "image_urls": f"""with i as (select page_id, {_IMG} as u from pages) select page_id, page_id % 4 in (0, 2, 3) as probable,
      case page_id % 4 when 0 then {_HOST.format(u='u')} || '/images/photo-' || page_id || '?v=' || page_id when 1 then {_HOST.format(u='u')} || '/static/logo' when 2 then {_HOST.format(u='u')} || '/media/' || page_id else {_HOST.format(u='u')} || '/a/' || page_id || '?a=1&b=2' end as identity from i""",
    "dedup_exact_text": f"with {ARTICLES_SQL}, k as (select id, {WORDS('content')} as k from articles) select id, min(id) over (partition by k) as kept_id, count(*) over (partition by k) as copies from k",
    "survivor_choice": f"with {ARTICLES_SQL}, k as (select id, url, id * 37 % 11 as score, length(content) as n from articles) select id, url from k qualify row_number() over (partition by url order by score desc, n desc, id desc) = 1",
    "semantic_pairs": "with e as (select vec_id, embedding::double[] as v from embeddings) select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 5) as similarity from e a join e b on a.vec_id < b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.4",
    "vector_topk": "with e as (select vec_id, embedding::double[] as v from embeddings), s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(q.v, e.v), 9) as s from e q cross join e where q.vec_id % 100 = 0) select query_id, id, round(s, 5) as similarity, row_number() over (partition by query_id order by s desc, id)::int as place from s qualify place <= 5",
    "retrieval_metrics": """with e as (select vec_id, label, embedding::double[] as v from embeddings), s as (select q.vec_id as query_id, q.label as ql, e.label as l, e.vec_id as id, round(list_cosine_similarity(q.v, e.v), 9) as s from e q cross join e where q.vec_id % 100 = 0 and q.vec_id <> e.vec_id),
      r as (select *, row_number() over (partition by query_id order by s desc, id) as place from s qualify place <= 5), f as (select query_id, min(case when ql = l then place end) as p, max(s) as top from r group by query_id)
      select count(*) as n, round(avg(case when p <= 1 then 1.0 else 0.0 end), 6) as recall_1, round(avg(case when p <= 3 then 1.0 else 0.0 end), 6) as recall_3, round(avg(case when p <= 5 then 1.0 else 0.0 end), 6) as recall_5, round(avg(coalesce(1.0 / p, 0.0)), 6) as mrr, round(avg(top), 6) as average_similarity from f""",
    "layout": f"with {ARTICLES_SQL} select id, case when {_WC} >= {C.LONG} then 'feature_long' when id % 3 = 0 then 'feature_image' when {_WC} >= {C.MEDIUM} then 'feature_medium' else 'standard' end as layout from articles",
    "sections": f"with {_RELEVANT}, g as (select category, count(*) as n, min(id) as first from relevants group by category) select row_number() over (order by coalesce(list_position([{', '.join(map(quoted, L.CATEGORY_ORDER))}], category), 99), first)::int as number, category, n, first from g",
    "composition_order": f"with {ARTICLES_SQL}, r as (select id, case when id % 3 = 0 then id % 17 end as rank from articles) select id, row_number() over (order by rank nulls last, id::varchar)::bigint as position from r",
    "asset_lookup": f"with {ARTICLES_SQL}, f as (select id, 'data/img/' || (id * 7 % 10) || '-' || n || '.jpg' as path from articles, (values (3), (1), (2)) v(n) where id % 2 = 0) select a.id, '../' || substr(min(f.path), 6) as asset from articles a left join f on a.id = f.id group by a.id",
    "image_rank": "select vec_id as image_id, vec_id % 50 as article_id, row_number() over (partition by vec_id % 50 order by abs(embedding[1]::double) desc, vec_id)::int as rank from embeddings",
    "best_image": "select vec_id % 50 as article_id, vec_id as image_id from embeddings where abs(embedding[1]::double) >= 0.2 qualify row_number() over (partition by vec_id % 50 order by abs(embedding[1]::double) desc, vec_id) = 1",
    "image_batch_summary": "select count(*) as articles, sum(vec_id % 3)::bigint as found, sum(vec_id % 2)::bigint as kept from embeddings",
    "hash_similarity": "with i as (select vec_id as a, vec_id * 1000003 % 4294967291 as h from embeddings) select x.a, round(1 - bit_count(xor(x.h, y.h)) / 64.0::double, 6) as similarity from i x join i y on y.a = x.a + 1",
    "editorial_totals": f"with {ARTICLES_SQL} select count(*) as total, count(*) filter (where id % 3 <> 0) as approved, count(*) filter (where id % 3 = 0) as failed from articles",
    "upsert": f"with {ARTICLES_SQL} select id, case when id % 2 = 0 then 'new' else 'old' end as origin from articles",
    "selection_reason": f"""with {_SCORED} select id, case when id % 5 = 0 then 'by hand' else 'Category: ' || category || case when article_score > 0 then '; Score ' || round_even(article_score, 0)::int || '/100' else '' end
      || case when security_part >= 20 then '; Security relevance ' || round_even(security_part, 0)::int || '/100' else '' end end as reason from scored""",
    "image_candidates": """with b as (select page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as base from pages)
      select page_id, 1 as place, 'og:image' as kind, base || '/media/' || page_id || '.jpg?w=9' as image_url from b union all select page_id, 2, 'article-image', base || '/uploads/x' from b""",
    "claim_grounding": f"with {_JUDGED} select draft_id, paragraph, sentence, source_id, similarity, array_to_string(errs, '; ') as errors, supported from judged",
    "draft_verdicts": f"with {_VERDICTS} select draft_id, missing::varchar as missing_ids, invalid::varchar as invalid_ids, n_claims, n_supported, n_uncited, grounding_score, grounded from verdicts",
    "draft_status": f"with {_VERDICTS} select draft_id, case when draft_id % 11 = 0 then 'invalid_json' else status end as status from status",
    "editorial_records": f"with {_VERDICTS} select draft_id, case when status = 'success' then 'approved' else 'failed' end as status, case when status = 'success' then 'A headline' else '' end as headline, md5(case when status = 'success' then article else '' end) as article, case when status = 'success' then source_ids else [] end::varchar as source_ids, case when status <> 'success' then status end as reason from status",
    "cited_metadata": f"with {_MADE}, x as (select draft_id, unnest(source_ids) as source_id from made) select x.draft_id, x.source_id, src.title, src.title is null as missing from x left join src on x.draft_id = src.draft_id and x.source_id = src.source_id",
    "last_attempts": f"with {ARTICLES_SQL} select id as draft_id, case when id % 3 = 0 then 2 else 1 end as attempt, case id % 3 when 1 then 'success' when 2 then 'invalid_json' else case when id % 2 = 0 then 'success' else 'grounding_failed' end end as status from articles",
    "numbers_and_dates": f"with {ARTICLES_SQL}, r as (select id, content || ' On 5 March 2024, 2023-01-02 and 12/11/2020 it was 50% of 3.5 km in 1999.' as c from articles) select id, array_to_string({NUMBERS('c')}, ',') as numbers, array_to_string({dates('c')}, ',') as dates from r",
    "record_normalise": f"""with {ARTICLES_SQL}, b as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as body from articles)
      select id::varchar as article_id, case when id % 2 = 0 and title <> '' then title when title <> '' then title else 'Untitled' end as headline, md5(body) as body, '{L.REGIONAL}' as category, case when id % 3 = 0 or coalesce(source, '') = '' then 'Unknown Source' else source end as source, [id::int]::varchar as source_ids, {WORD_COUNT('body')}::int as words from b""",
    "negative_rejection": "with e as (select vec_id, embedding::double[] as v from embeddings), t as (select q.vec_id as id, max(round(-list_cosine_similarity(q.v, e.v), 9)) as s from e q cross join e where q.vec_id % 100 = 0 group by 1) select count(*) as negative, count(*) filter (where s < 0.45) as rejected, round(count(*) filter (where s < 0.45) / count(*), 6) as rejection_rate from t",
    "vector_info": "select count(*) as vectors, count(distinct vec_id) as ids, 0::bigint as missing, 64 as least, 64 as largest, count(*) = count(distinct vec_id) as sound from embeddings",
    "pipeline_metrics": "with r as (select vec_id as i from embeddings) select count(*) as total, count(*) filter (where i % 2 = 0) as retrieval, count(*) filter (where i % 3 > 0) as json, count(*) filter (where i % 5 > 0) as citation, count(*) filter (where i % 7 > 0 and i % 4 = 0) as grounding, sum(i % 11)::bigint as n_claims, sum(least(i % 11, i % 7))::bigint as n_supported, round(avg(case when i % 6 > 0 then (i % 64) / 64.0::double end), 6) as average_similarity, round(sum(least(i % 11, i % 7))::double / sum(i % 11), 6) as support_rate from r",
    "category_scan": f"with {_SCORED} select id, category, row_number() over (order by article_score desc, id)::bigint as position from scored where category in {strings(L.CATEGORY_ORDER)}",
    "collection_funnel": f"""with {ARTICLES_SQL}, k as (select distinct url as known from articles where id % 20 = 0), g as (select a.*, case when len({_ERRORS}) > 0 then 'invalid' when not {_IN} then 'outside_date_range' when k.known is not null then 'duplicates' end as gate
      from articles a left join k on a.url = k.known where id % 13 <> 0), h as (select coalesce(gate, case when row_number() over (partition by url, gate is null order by id) > 1 then 'duplicates' else 'saved' end) as gate from g), c as (select gate, count(*) as n from h group by gate
      union all select 'discovered', count(*) from articles union all select 'scraped', count(*) from articles where id % 13 <> 0 union all select 'failed', count(*) from articles where id % 13 = 0)
      select x.counter, coalesce(c.n, 0) as n from (select unnest(['discovered', 'scraped', 'invalid', 'outside_date_range', 'duplicates', 'saved', 'failed']) as counter) x left join c on c.gate = x.counter""",
    "json_lines": f"with {ARTICLES_SQL} select id, title, source from articles",
    "json_document": f"with {_RELEVANT}, t as (select id, title, category, case when id % 2 = 0 then 'approved' else 'failed' end as status from relevants order by coalesce(article_score, 0) desc, id limit 11) select *, (select count(*) from t) as total, (select count(*) from t where status = 'approved') as approved, (select count(*) from t where status = 'failed') as failed from t",
    "document_texts": f"""with {ARTICLES_SQL} select id, md5('Title: ' || title || chr(10) || chr(10) || 'Source: ' || source || chr(10) || 'Published: ' || strftime(published_date, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Category: c' || id % 5 || chr(10) || chr(10) || 'Content:' || chr(10) || content) as document,
      md5(trim('Title: ' || title || chr(10) || chr(10) || 'Content:' || chr(10) || content, ' ')) as embedding, md5('[Source ' || id % 9 || ']' || array_to_string(list_transform([['Article ID', id::varchar], ['Title', title], ['Source', source], ['Published Date', strftime(published_date, '%Y-%m-%d')], ['Category', 'c' || id % 5],
      ['Article Score', (id % 101)::varchar], ['Retrieval Similarity', printf('%.4f', (id % 100) / 100.0::double)], ['Content', content]], lambda x: chr(10) || chr(10) || x[1] || ':' || chr(10) || x[2]), '')) as context from articles""",
    "retrieval_query": f"with {ARTICLES_SQL} select id, case when id % {len(T.GENERATOR_STARTS) + 1} = {len(T.GENERATOR_STARTS)} then 'Tell Me Of  border towns ' else 'border towns ' end || id as asked from articles",
    "path_rewrite": f"with {ARTICLES_SQL} select id, case id % 3 when 0 then 'img/' when 1 then 'data/img/' else '/other/img/' end || id || '.png' as relative, case id % 3 when 0 then '/srv/edition/img/' when 1 then '../img/' else '/other/img/' end || id || '.png' as asset from articles",
    "domain_quality": f"with q as (select page_id, case page_id % 6 when 0 then 1.0 when 1 then 0.75 when 2 then 0.1 when 3 then 0.3 else case when {_DOMAIN} = '' then 0.3 when {_DOMAIN} in {strings(U.BEST_SOURCES)} then 1.0 when {_DOMAIN} in {strings(U.GOOD_SOURCES)} then 0.75 when {' or '.join(f'contains({_DOMAIN}, {quoted(b)})' for b in U.POOR_SOURCES)} then 0.1 else 0.5 end end::double as quality from pages) select *, quality > 0.1 as accepted from q",
    "state_mentions": f"with {ARTICLES_SQL} select name, count(*) as n from articles, (values ('Assam'), ('Mizoram')) v(name) where id % 4 = 0 group by name",
    "source_lines": f"with {ARTICLES_SQL}, c as (select case when trim(coalesce(source, '')) = '' then 'Unknown Source' else trim(source) end as source, count(*) as n from articles group by 1) select source || ': ' || n || ' article(s)' as line from c",
    "selection_appendix": f"""with {_RELEVANT} select id, title, category, case when trim(coalesce(source, '')) = '' then 'Unknown Source' else source end as source, article_score, security_part, row_number() over (order by id % 7, id)::bigint as number,
      'Category: ' || category || case when article_score > 0 then '; Score ' || round_even(article_score, 0)::int || '/100' else '' end || case when security_part >= 20 then '; Security relevance ' || round_even(security_part, 0)::int || '/100' else '' end as reason from relevants""",
    "toc": f"with {_RELEVANT}, g as (select category, count(*) as n, min(id) as first from relevants group by category), k as (select *, row_number() over (order by coalesce(list_position([{', '.join(map(quoted, L.CATEGORY_ORDER))}], category), 99), first)::int as number from g) select k.number, r.category, k.n, row_number() over (partition by r.category order by r.id)::bigint as place, r.id, r.title from relevants r join k on r.category = k.category",
    "page_lookup": f"with {ARTICLES_SQL} select p.id + 1 as page_number, p.id * 3 as id, a.title as headline, a.title is null as unresolved from articles p left join articles a on a.id = p.id * 3 where p.id % 5 > 0",
    "plan_offenders": f"with {ARTICLES_SQL}, p as (select id - case when id % 50 = 49 then 1 else 0 end as page_number, case when id % 40 <> 7 then 'article' end as kind, {_WC} as words from articles), q as (select page_number, case when kind is null then 'no kind' when count(*) over (partition by page_number) > 1 then 'repeated number' when words = 0 then 'empty part' when words > {C.CONTINUATION} then 'part too long' end as problem from p) select * from q where problem is not null",
    "text_checks": f"with {ARTICLES_SQL} select 'page_text' as check, count(*) filter (where length(trim(content, ' ')) < 10) = 0 as passed from articles union all select 'marker the', bool_or(contains(content, 'the')) from articles union all select 'marker zzzz no such marker', bool_or(contains(content, 'zzzz no such marker')) from articles",
    "migrated": f"with {ARTICLES_SQL} select id, (id % 9)::int as article_score, 0 as relevance_score, null::int as rank, null::varchar as category, 16 as columns from articles",
    "accepted_images": """with i as (select vec_id % 50 as article_id, vec_id as position, 'https://x.example.com/' || vec_id % 200 as image_url, sha256(vec_id::varchar) as name from embeddings where vec_id % 5 > 0 and vec_id % 700 >= 300 and vec_id % 500 >= 200),
      u as (select * from i qualify row_number() over (partition by article_id, image_url order by position) = 1) select * from u qualify row_number() over (partition by article_id order by position) <= 2""",
    "search_results": """with f as (select page_id, 9 as tier, 1 as place, 'https://own.example.com/media/' || page_id || '.jpg' as image_url from pages where page_id % 3 > 0 union all select page_id, v.tier, v.place, v.host || page_id || '.jpg' from pages,
      (values (3, 0, 'https://thehindu.com/media/a'), (2, 1, 'https://eastmojo.com/media/b'), (1, 3, 'https://any.example.org/media/d'), (1, 4, 'https://any.example.org/media/e')) v(tier, place, host))
      select page_id, row_number() over (partition by page_id order by tier desc, place)::int as position, image_url from f qualify position <= 4""",
    "stage_runs": f"with {ARTICLES_SQL} select 1 as place, 'articles' as stage, 'passed' as status, count(*) as rows from articles union all select 2, 'valid', 'passed', count(*) from articles where len({_ERRORS}) = 0 union all select 3, 'in window', 'passed', count(*) from articles where len({_ERRORS}) = 0 and {_IN}",
    "text_image_relevance": """with e as (select vec_id, vec_id // 10 as article_id, embedding::double[] as v from embeddings), s as (select i.article_id, i.vec_id as image_id, round(list_cosine_similarity(i.v, t.v), 6) as score from e i left join e t on t.vec_id = i.article_id * 10 where i.vec_id % 10 > 0)
      select article_id, image_id, score, score >= 0.10 as relevant, row_number() over o::int as rank, row_number() over o = 1 and score >= 0.10 as best from s window o as (partition by article_id order by score desc, image_id)""",
    "lexicon_hits": f"with {_BASE}, hits as (" + " union all ".join(f"select id, {quoted(name)} as lexicon, {total('a', terms)}::bigint as score, len({found('a', terms)})::bigint as n_terms from m" for name, terms in {"states": X.states, "entities": X.entities, "region": X.region, "irrelevant": X.irrelevant, **X.themes}.items()) + ") select * from hits where n_terms > 0",
    "claim_grounding_cached": f"with {_JUDGED} select draft_id, paragraph, sentence, source_id, similarity, array_to_string(errs, '; ') as errors, supported from judged",
    "text_findings": f"{_FINDINGS} select severity, check_name as check, page_number, detail from f",
    "text_accepted": f"{_FINDINGS} select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'error') = 0 as passed from f",
    "edition_checks": f"""with {ARTICLES_SQL}, e as (select id, source, length(title) as n, string_split(content, chr(10)) as l from articles),
      m as (select *, list_filter([case when source = 'src1' then 'charts' end, case when n % 9 = 0 then 'validation' end], lambda x: x is not null) as gone from e)
      select id as edition, case when source = 'src5' then 'no JSON object' when len(gone) > 0 then 'missing keys: ' || array_to_string(gone, ', ') when source = 'src2' then 'articles is no list' when source = 'src4' then 'page_plan is no list'
        when len(l) <> 4 then 'expected 4 pages, found ' || len(l) when len(list_filter(l, lambda x: length(x) > 150)) = 0 then 'no articles' end as problem, len(l) as html_pages, problem is null and len(l) = 4 as valid from m""",
    # per article, images in order of id with the list of those kept so far
    "image_dedup": """with recursive h as (select vec_id % 50 as article, vec_id, vec_id * 1000003 % 4294967291 as hash, row_number() over (partition by vec_id % 50 order by vec_id) as i from embeddings),
      r as (select distinct article, 0::bigint as i, null::bigint as image_id, null::bigint as kept_id, null::int as distance, []::struct(d int, id bigint, hash bigint)[] as kept from h
        union all select x.article, x.i, x.vec_id, case when x.near.d <= 6 then x.near.id end, x.near.d, case when x.near.d <= 6 then x.kept else list_append(x.kept, {'d': 64, 'id': x.vec_id, 'hash': x.hash}) end
        from (select h.article, h.i, h.vec_id, h.hash, r.kept, list_min(list_transform(r.kept, lambda k: {'d': bit_count(xor(k.hash, h.hash))::int, 'id': k.id})) as near from r join h on h.article = r.article and h.i = r.i + 1) x)
      select image_id, kept_id, coalesce(distance, 64) as distance, 1 - coalesce(distance, 64) / 64::double as similarity from r where i > 0""",
    "embedding_cache": f"""with {ARTICLES_SQL}, t as (select distinct title from articles where title is not null), v as (select title, {VECTOR('title')} as v from t)
      select sha256(title) as key, case when list_dot_product(v, v) > 0 then round(v[1] / sqrt(list_dot_product(v, v)), 6) end as share_of_a, (select count(*) from t) as embedded_first, 0::bigint as embedded_again from v""",
    # images in order of id with the list of those kept so far; a bit string a hash
    "image_set_dedup": """with recursive h as (select row_number() over (order by vec_id) as i, vec_id, list_transform(embedding, lambda x: (x > 0)::int) as bits from embeddings),
      r as (select 0::bigint as i, null::bigint as image_id, null::bigint as kept_id, null::int as distance, []::struct(d int, id bigint, bits int[])[] as kept
        union all select x.i, x.vec_id, case when x.near.d <= 6 then x.near.id end, case when x.near.d <= 6 then x.near.d end, case when x.near.d <= 6 then x.kept else list_append(x.kept, {'d': 64, 'id': x.vec_id, 'bits': x.bits}) end
        from (select h.i, h.vec_id, h.bits, r.kept, list_min(list_append(list_transform(r.kept, lambda k: {'d': list_sum(list_transform(list_zip(k.bits, h.bits), lambda z: (z[1] <> z[2])::int))::int, 'id': k.id}), {'d': 99, 'id': 0::bigint})) as near from r join h on h.i = r.i + 1) x)
      select image_id, kept_id, distance, case when distance is null then 0.0 else 1 - distance / 64::double end as similarity from r where i > 0""",
    "page_chunks": f"""with {ARTICLES_SQL}, {_chunks('select id, content from articles')}
      select id, k::int as part, len(cs)::int as parts, case when k = 1 then 'opener' else 'continuation' end as role, {WORD_COUNT('cs[k]')}::int as words, md5(cs[k]) as chunk from chunked""",
    "page_plan": f"{_PLAN} select page_number, kind, category, id, part from plan",
    "page_plan_check": f"""{_PLAN} select count(*) as pages, count(*) filter (kind = 'article') as article_pages, count(*) filter (kind is null) as untyped, count(page_number) - count(distinct page_number) as repeated,
      count(*) = {C.PAGES} and count(*) filter (kind is null) = 0 and count(page_number) = count(distinct page_number) as valid from plan""",
    "query_variants": f"""with {ARTICLES_SQL}, a as (select id, {_CLEANED("'Write an article about ' || title || ' using only retrieved evidence.'")} as q from articles), k as (select id, q, lower(q) as low, {_KEYS.replace('title', 'q')} as ks from a),
      v as (select id, q, list_filter(list_transform(list_filter([q, low, case when len(ks) >= 4 then array_to_string(ks, ' ') end, case when contains(low, 'india-myanmar') then replace(low, 'india-myanmar', 'myanmar border') end,
        case when contains(low, 'india myanmar') then replace(low, 'india myanmar', 'myanmar border') end], lambda x: x is not null), lambda x: trim(x, ' ')), lambda x: x <> '') as vs from k)
      select id, q, array_to_string({_FIRSTS('vs')}, '|') as variants from v""",
    "image_queries": f"""with {ARTICLES_SQL}, a as (select id, lower(coalesce(title, '')) as low, lower(coalesce(source, '')) as kind from articles),
      b as (select *, list_transform(regexp_extract_all(low, '[a-z][a-z''-]+'), lambda x: trim(x, chr(39))) as raw, {_LONGEST(X.security_hits)} as ev, {_LONGEST(("the", "ea", "que"))} as pl from a),
      c as (select *, list_filter(raw, lambda x: length(x) >= 3 and x not in {strings(I.PHRASE_STOPWORDS)} and x not in {strings(I.GENERIC)}) as w1 from b), w as (select *, {_FIRSTS('w1')} as w from c),
      f as (select id, list_filter([case when len(ev) > 0 and len(pl) > 0 then array_to_string(list_concat(ev[1:3], pl[1:2]), ' ') end, case when len(w) > 0 then array_to_string(list_concat(w[1:7], pl[1:2]), ' ') end,
        case when len(w) > 0 then array_to_string(list_concat(list_concat(w[1:6], pl[1:1]), ['news photo']), ' ') end, case when len(w) > 0 and kind <> '' then array_to_string(list_concat(list_concat(w[1:5], pl[1:1]), [kind || ' photo']), ' ') end], lambda x: x is not null) as ph from w)
      select id, array_to_string(({_FIRSTS('ph')})[1:4], '|') as phrases from f""",
}
