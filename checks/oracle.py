"""DuckDB SQL for the queries, written apart from the Spark expressions."""

from __future__ import annotations

from checks.views import DUCK_VIEWS, duck
from ripplemark.functions import facts as X
from ripplemark.functions import paths as P
from ripplemark.functions import words as W
from ripplemark.operators import selection, services

_SQL: dict[str, str] = {}


def _list(words) -> str:
    return "(" + ", ".join(_text(w) for w in words) + ")"


def _text(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


# ---------------------------------------------------------- path phrases --


def name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def ext(p: str) -> str:
    return f"lower(regexp_extract({name(p)}, '^.+\\.([^.]+)$', 1))"


def stem(p: str) -> str:
    return f"regexp_replace({name(p)}, '^(.+)\\.[^.]+$', '\\1')"


def directory(p: str) -> str:
    return f"case when contains({p}, '/') then left({p}, length({p}) - length({name(p)}) - 1) else '' end"


def parts(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda x: x not in ('', '.'))"


def parents(p: str) -> str:
    return f"({parts(p)})[1:len({parts(p)}) - 1]"


def any_part(p: str, names) -> str:
    return f"len(list_filter({parts(p)}, lambda x: x in {_list(names)})) > 0"


def is_source(p: str) -> str:
    return f"({ext(p)} in {_list(P.SOURCE_EXTENSIONS)})"


def is_config(p: str) -> str:
    low = f"lower({name(p)})"
    markers = " or ".join(f"contains({low}, {_text(m)})" for m in P.CONFIG_NAME_MARKERS)
    starts = " or ".join(f"starts_with({low}, {_text(m)})" for m in P.CONFIG_NAME_STARTS)
    return (
        f"(len(list_filter({parents(p)}, lambda d: lower(d) in {_list(P.CONFIG_DIRS)})) > 0"
        f" or {low} in {_list(P.CONFIG_FILE_NAMES)} or {markers}"
        f" or ({ext(p)} in {_list(P.CONFIG_EXTENSIONS)} and not {is_source(p)}) or {starts})"
    )


def is_test(p: str) -> str:
    return f"({is_source(p)} and (contains(lower({name(p)}), 'test') or contains(lower({name(p)}), 'spec')))"


def category(p: str) -> str:
    return f"case when {is_config(p)} then 'config' when {is_source(p)} then 'source' end"


def is_artifact(p: str) -> str:
    ends = " or ".join(f"ends_with({p}, {_text(s)})" for s in P.ARTIFACT_SUFFIXES)
    return f"({name(p)} in {_list(P.ARTIFACT_NAMES)} or {ends} or {any_part(p, P.ARTIFACT_DIRS)})"


def is_skipped(p: str) -> str:
    return f"({any_part(p, P.SCAN_SKIP_DIRS)})"


def words(t: str) -> str:
    return (
        f"list_filter(list_distinct(list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*'), "
        "lambda w: lower(w))), lambda w: length(w) > 2)"
    )


def terms(t: str) -> str:
    stop = "[" + ", ".join(_text(w) for w in W.default_stop_words()) + "]"
    return f"list_filter({words(t)}, lambda w: not list_contains({stop}, w))"


def strip(t: str) -> str:
    space = "[\\s\\v\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+"
    return f"regexp_replace({t}, '^{space}|{space}$', '', 'g')"


# Service names step by step; q is the frame (path).
def service_name_steps(source: str) -> str:
    prefixes = " ".join(
        f"when starts_with(s, {_text(x)}) then substr(s, {len(x) + 1})" for x in P.SERVICE_NAME_PREFIXES
    )
    suffixes = " ".join(
        f"when ends_with(n, {_text(x)}) then left(n, length(n) - {len(x)})"
        for x in sorted(P.SERVICE_NAME_SUFFIXES, key=len, reverse=True)
    )
    return f"""
      select path, case
          when by_dir is not null then left(by_dir, length(by_dir) - 8)
          when n2 <> '' and n2 not in {_list(P.GENERIC_NAMES)} then n2
          when from_dir is not null then case when right(from_dir, 4) in ('-api', '_api')
               then left(from_dir, length(from_dir) - 4) else from_dir end
          when n2 <> '' then n2 else s end as service
      from (select path, s, trim(n1, '._-') as n2,
              list_filter(up, lambda d: right(d, 8) in ('-service', '_service'))[1] as by_dir,
              list_filter(up, lambda d: d not in {_list(P.PLAIN_DIRS)})[1] as from_dir
            from (select *, case {suffixes} else n end as n1
                  from (select *, case {prefixes} else s end as n
                        from (select path, lower({stem('path')}) as s,
                                list_reverse(list_transform({parents('path')}, lambda d: lower(d))) as up
                              from {source}) a) b) c) d"""


# ------------------------------------------------------- shared views --

DUCK_VIEWS["o_changes"] = f"""
select n.path, case when o.path is null then 'added' else 'modified' end as change_kind
from files_new n left join files_old o on n.path = o.path
where o.path is null or o.content <> n.content
"""
DUCK_VIEWS["o_reviewed"] = f"""
select path, change_kind, {category('path')} as category from o_changes where not {is_artifact('path')}
"""
DUCK_VIEWS["o_corpus"] = f"""
select path, content from files_new where {is_source('path')} and not {is_skipped('path')}
"""
DUCK_VIEWS["o_tests"] = f"select path, content from o_corpus where {is_test('path')}"
DUCK_VIEWS["o_corpus_terms"] = f"select path, unnest({terms('content')}) as term from o_corpus where content <> ''"
DUCK_VIEWS["o_test_terms"] = f"select path, term from o_corpus_terms where {is_test('path')}"
DUCK_VIEWS["o_idf"] = """
select term, df, case when n > 1 then ln(n / (1 + df)) else 1.0 end as idf
from (select term, count(*) as df from o_corpus_terms group by term) t,
     (select count(*) as n from o_corpus where content <> '') c
"""


def diff_lines(files: str) -> str:
    return f"""
      select path, unnest(string_split(
        case when ends_with(content, chr(10)) then content[:-2] else content || chr(1) end, chr(10))) as line
      from {files} where content <> '' and path in (select path from o_reviewed)"""


DUCK_VIEWS["o_lines"] = f"""
select path, side, rtrim(line, chr(1)) as line, count(*) as copies from (
  select path, '+' as side, line from ({diff_lines('files_new')} except all {diff_lines('files_old')}) a
  union all
  select path, '-' as side, line from ({diff_lines('files_old')} except all {diff_lines('files_new')}) b
) group by path, side, rtrim(line, chr(1))
"""
DUCK_VIEWS["o_mentions"] = f"""
select distinct path, unnest(regexp_extract_all(line, {_text(services.MENTION_RE)}, 1)) as service
from o_lines where path in (select path from o_reviewed where category = 'config')
"""
DUCK_VIEWS["o_services"] = f"""
select distinct service from (
  {service_name_steps("(select path from o_reviewed where category is not null)")}
  union all select null, service from o_mentions) where service <> ''
"""


def property_facts(files: str, comment: str, colon: bool, unquote: bool) -> str:
    cut = "case when contains(ln, '=') then strpos(ln, '=') else strpos(ln, ':') end" if colon else "strpos(ln, '=')"
    value = "v"
    if unquote:
        value = (
            "case when length(v) >= 2 and left(v, 1) = right(v, 1) and left(v, 1) in ('\"', '''') "
            "then substr(v, 2, length(v) - 2) else v end"
        )
    return f"""
      select path, key, arg_max({value}, i) as value, 'string' as value_type from (
        select path, i, {strip("left(ln, cut - 1)")} as key, {strip("substr(ln, cut + 1)")} as v from (
          select path, i, ln, {cut} as cut from (
            select path, i, {strip('raw')} as ln from (
              select path, unnest(ls) as raw, generate_subscripts(ls, 1) as i
              from (select path, string_split_regex(content, '\\r\\n|\\r|\\n') as ls from {files}) a) b) c
          where ln <> '' and left(ln, 1) not in {comment}) d
        where cut > 0) e group by path, key"""


def js_facts(files: str) -> str:
    pair = _text(X.JS_PAIR_RE)
    return f"""
      select path, key, arg_max(value, i) as value, arg_max(value_type, i) as value_type from (
        select path, i, key,
          case when lit = 'null' then '' when lit in ('true', 'false') then lit
               when num <> '' and contains(num, '.') then cast(cast(num as double) as varchar)
               when num <> '' then cast(cast(num as hugeint) as varchar) else lit end as value,
          case when lit = 'null' then 'null' when lit in ('true', 'false') then 'bool'
               when num <> '' and contains(num, '.') then 'float' when num <> '' then 'int' else 'string' end as value_type
        from (select path, i, regexp_extract(m, {pair}, 1) as key, regexp_extract(m, {pair}, 4) as num,
                regexp_extract(m, {pair}, 2) || regexp_extract(m, {pair}, 3) || regexp_extract(m, {pair}, 4)
                  || regexp_extract(m, {pair}, 5) as lit
              from (select path, unnest(ms) as m, generate_subscripts(ms, 1) as i from (
                select path, regexp_extract_all(regexp_replace(regexp_replace(body, '//[^\\n]*', '', 'g'),
                  '(?s)/\\*.*?\\*/', '', 'g'), {pair}, 0) as ms
                from (select path, coalesce(regexp_extract_all(content, {_text(X.JS_EXPORT_RE)}, 1)[1],
                  regexp_extract_all(content, {_text(X.JS_ASSIGNED_RE)}, 1)[1]) as body from {files}) a) b) c) d) e
      group by path, key"""


def config_facts(version: str) -> str:
    docs, values = f"config_{version}", f"config_{version}_values"

    def known(fmt: str, rows: list[tuple[str, str, str]]) -> str:
        one = ", ".join(f"struct_pack(key := {k}, value := {v}, value_type := '{t}')" for k, v, t in rows)
        return f"""select path, f.key, f.value, f.value_type
          from (select path, unnest([{one}]) as f from {values} where format = '{fmt}')"""

    n = "cast(n as varchar)"
    js = f"""select path, key, case when value_type <> 'null' then value end as value, value_type
      from ({js_facts(f"(select * from {docs} where ends_with(path, '.config.js'))")})"""
    return " union all ".join([
        property_facts(f"(select * from {docs} where ends_with(path, '.properties'))", "('#', '!')", True, False),
        property_facts(f"(select * from {docs} where ends_with(path, '.env'))", "('#')", False, True),
        js,
        known("json", [
            ("'server.timeout'", n, "int"), ("'server.retry.attempts'", "'3'", "int"),
            ("'server.tags'", "'[\"a\",1]'", "list"), ("'owner'", "owner", "string"),
            ("'rate'", f"{n} || '.5'", "float"), ("'on'", "'true'", "bool"), ("'off'", "cast(null as varchar)", "null"),
        ]),
        known("xml", [
            ("'config.server.timeout'", n, "string"), ("'config.owner'", "owner", "string"),
            ("'config.empty'", "''", "string"),
        ]),
        known("yaml", [
            ("'Deployment/' || svc || '.kind'", "'Deployment'", "string"),
            ("'Deployment/' || svc || '.metadata.name'", "svc", "string"),
            ("'Deployment/' || svc || '.spec.replicas'", n, "int"),
            ("'Deployment/' || svc || '.spec.template.spec.containers'",
             "'[{{\"env\":[{{\"name\":\"PEER\",\"value\":\"peer' || (n % 10) || 'service:80\"}}],\"name\":\"main\"}}]'", "list"),
            ("'doc1/doc1.debug'", "'true'", "bool"), ("'doc1/doc1.owner'", "owner", "string"),
        ]),
    ])


DUCK_VIEWS["o_facts_old"] = config_facts("old")
DUCK_VIEWS["o_facts_new"] = config_facts("new")
DUCK_VIEWS["o_config_changes"] = """
select coalesce(o.path, n.path) as path, coalesce(o.key, n.key) as key, o.value as old_value, o.value_type as old_type,
  n.value as new_value, n.value_type as new_type
from o_facts_old o full join o_facts_new n on o.path = n.path and o.key = n.key
where o.value is distinct from n.value
"""
DUCK_VIEWS["o_code_terms"] = f"""
select distinct unnest({terms('content')}) as term from files_new
where path in (select path from o_reviewed where category = 'source')
"""
_CHANGED_CONFIG = "(select * from files_new where path in (select path from o_reviewed where category = 'config'))"
DUCK_VIEWS["o_config_terms"] = f"""
select distinct unnest({terms('key')}) as term
from ({property_facts(_CHANGED_CONFIG, "('#', '!')", True, False)})
"""
DUCK_VIEWS["o_all_terms"] = "select term from o_code_terms union select term from o_config_terms"
DUCK_VIEWS["o_distinctive"] = """
select term from (select a.term, coalesce(i.idf, 0) > 1.5 as d, bool_or(coalesce(i.idf, 0) > 1.5) over () as any_d
  from o_all_terms a left join o_idf i on a.term = i.term) where d or not any_d
"""


def lexical(chosen: str) -> str:
    return f"""
      select t.path, coalesce(h.n / (select count(*) from {chosen}), 0.0) as lexical
      from o_tests t left join (select path, count(*) as n from o_test_terms
        where term in (select term from {chosen}) group by path) h on t.path = h.path"""


DUCK_VIEWS["o_lexical"] = lexical("o_distinctive")
DUCK_VIEWS["o_lexical_config"] = lexical("o_config_terms")
DUCK_VIEWS["o_relevance"] = f"""
select path, max(cast(case
    when regexp_matches(st, '(?:^|[_\\-.])' || regexp_escape(s) || '(?:$|[_\\-.])') then 1.0
    when seg is not null then seg
    when length(root) >= 5 and regexp_matches(st, '(?:^|[_\\-.])' || regexp_escape(root) || '(?:$|[_\\-.])') then 0.7
    when regexp_matches(body, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:import|from)\\s+' || regexp_escape(s) || '(?:$|[^\\p{{L}}\\p{{N}}_])') then 0.4
    when regexp_matches(body, '/' || regexp_escape(s) || '(?:-service)?/') then 0.3
    else 0.0 end as double)) as service_score
from (select t.path, lower({stem('t.path')}) as st, lower(t.content) as body, lower(v.service) as s,
        trim(replace(lower(v.service), 'service', ''), '-_') as root,
        list_filter(list_transform(string_split(lower(t.path), '/'), lambda p:
          case when p in (lower(v.service) || '-service', lower(v.service) || '_service') then 0.95
               when p = lower(v.service) then 0.9 end), lambda z: z is not null)[1] as seg
      from o_tests t cross join o_services v) x
group by path
"""
DUCK_VIEWS["o_ranked"] = """
select path, lexical, service_score, round(sum, 6) as score
from (select r.path, l.lexical, r.service_score, 0.3::double * l.lexical + 0.7::double * r.service_score as sum
  from o_relevance r join o_lexical l on r.path = l.path) where sum > 0 and sum >= 0.55::double
"""
DUCK_VIEWS["o_entries"] = """
select 'changed_files' as section, path, cast(null as double) as score from o_reviewed
union all select category || '_files', path, null from o_reviewed where category is not null
union all select 'affected_tests', path, score from o_ranked
"""

# ------------------------------------------------------ sources and sinks --

_SQL["s1_corpus_scan"] = "select path, length(content) as n_chars, sha256(content) as digest from o_corpus"
_SQL["s2_change_set"] = "select path, change_kind from o_changes"
_SQL["s2_renames"] = """
with come as (select *, row_number() over (partition by content order by path) as r from files_moved
    where path not in (select path from files_new)),
gone as (select *, row_number() over (partition by content order by path) as r from files_new
    where path not in (select path from files_moved)),
moved as (select c.path, g.path as old_path from come c join gone g on c.content = g.content and c.r = g.r),
left_new as (select path, content, regexp_extract(path, '[^/]*$') as name from come where path not in (select path from moved)),
left_old as (select path, content, regexp_extract(path, '[^/]*$') as name from gone where path not in (select old_path from moved)),
lines_new as (select path, line, count(*) as n from (select path, unnest(string_split(content, NL)) as line from left_new) group by all),
lines_old as (select path, line, count(*) as n from (select path, unnest(string_split(content, NL)) as line from left_old) group by all),
shared as (select a.path, b.path as old_path, sum(least(a.n, b.n) * (length(a.line) + 1)) as w
    from lines_new a join lines_old b on a.line = b.line group by a.path, b.path),
near as (select s.path, s.old_path, w / greatest(length(a.content) + 1, length(b.content) + 1) as share, a.name = b.name as same, a.name
    from shared s join left_new a on s.path = a.path join left_old b on s.old_path = b.path
    where w / greatest(length(a.content) + 1, length(b.content) + 1) >= 0.5),
named as (select path, old_path from near where same and (select count(*) from left_new x where x.name = near.name) = 1
    and (select count(*) from left_old x where x.name = near.name) = 1),
placed as (select path, old_path, row_number() over (partition by path order by share desc, old_path) as p,
    row_number() over (partition by old_path order by share desc, path) as q
    from near where path not in (select path from named) and old_path not in (select old_path from named)),
renames as (select path, old_path from moved union all select path, old_path from named
    union all select path, old_path from placed where p = 1 and q = 1)
select n.path, case when r.old_path is not null then 'renamed' when o.path is null then 'added' else 'modified' end as change_kind, r.old_path
from files_moved n left join files_new o on n.path = o.path left join renames r on n.path = r.path
where o.path is null or o.content <> n.content
"""
_SQL["s3_changed_lines"] = "select path, side, line, copies from o_lines"
_SQL["s4_result_entries"] = "select section, path, score from o_entries"
_SQL["s5_result_summary"] = """
select count(*) filter (section = 'affected_tests') > 0 as has_affected_tests,
  count(*) filter (section = 'affected_tests') as test_count,
  count(*) filter (section = 'changed_files') as n_changed_files,
  count(*) filter (section = 'source_files') as n_source_files,
  count(*) filter (section = 'config_files') as n_config_files,
  (select count(*) from o_tests) as total_tests_analyzed
from o_entries
"""
_SQL["s6_request_bodies"] = """
select seq, not ok as rejected,
  case when ok then coalesce(json_extract_string(doc, '$.userId'), '') end as user_id,
  case when ok then coalesce(json_extract_string(doc, '$.plan'), 'basic') end as plan
from (select seq, json_valid(body) as ok, case when json_valid(body) then body end as doc
      from (select seq, case when body = '' then '{{}}' else body end as body from request_bodies))
"""

# ------------------------------------------------------------------ paths --

_SQL["p1_file_names"] = f"""
select path, {name('path')} as name, {stem('path')} as stem, {ext('path')} as ext, {directory('path')} as dir
from all_paths
"""
_SQL["p2_config_files"] = f"select path, {is_config('path')} as is_config from all_paths"
_SQL["p3_source_files"] = f"select path, {is_source('path')} as is_source from all_paths"
_SQL["p4_test_files"] = f"select path, {is_test('path')} as is_test from all_paths"
_SQL["p5_categories"] = f"select path, {category('path')} as category from all_paths"
_SQL["p6_path_exclusion"] = (
    f"select path, {is_artifact('path')} as is_artifact, {is_skipped('path')} as is_skipped from all_paths"
)
_SQL["p7_service_names"] = service_name_steps("all_paths")

_ITEM = (
    "list_filter(string_split(url_decode(replace(regexp_extract(path, '^[^?#]*\\?([^#]*)', 1), '+', '%2B')), '&'),"
    " lambda i: regexp_matches(i, '^userId=[^=]+=*$'))[1]"
)
_USER = f"coalesce(regexp_extract({_ITEM}, '=([^=]+)', 1), 'u1')"
_SQL["p10_query_parameters"] = f"select seq, {_USER} as user_id from requests"


def _to(route: str, status: int, miss: str = "null", path_id: str = "null") -> str:
    return (
        f"struct_pack(route := '{route}', path_id := cast({path_id} as varchar), "
        f"status := {status}, miss_status := cast({miss} as integer))"
    )


_LAST = "regexp_extract(plain, '([^/]*)$', 1)"
DUCK_VIEWS["o_routes"] = f"""
select seq, service, r.route, r.path_id, r.status, r.miss_status from (select seq, service, case
  when service in ('watchlist', 'history') then case
    when starts_with(plain, '/health') then {_to('health', 200)}
    when not starts_with(plain, '/' || service) then {_to('unknown', 404)}
    when method = 'GET' and service = 'watchlist' then {_to('watchlist list', 200, path_id=_USER)}
    when method = 'GET' then {_to('history list', 200, path_id=_USER)}
    when method = 'POST' and service = 'watchlist' then {_to('watchlist add', 201)}
    when method = 'POST' then {_to('history add', 201)}
    when service = 'watchlist' then {_to('watchlist refused', 405)} else {_to('history refused', 405)} end
  when service in ('auth', 'recommendation') and method = 'DELETE' then {_to('unsupported method', 501)}
  when service = 'recommendation' and method = 'POST' then {_to('unsupported method', 501)}
  when plain = '/health' and (method = 'GET' or service in ('subscription', 'notification')) then {_to('health', 200)}
  when service = 'catalog' and method = 'GET' and plain = '/movies' then {_to('movies', 200)}
  when service = 'catalog' and method = 'GET' and regexp_matches(plain, '^/movies/[^/]+$')
    then {_to('movie', 200, '404', "substr(plain, 9)")}
  when service = 'streaming' and method = 'POST' and plain = '/stream/start' then {_to('stream start', 201, '400')}
  when service = 'auth' and method = 'POST' and path = '/login' then {_to('login', 200, '401')}
  when service = 'recommendation' and starts_with(path, '/recommendations/')
    then {_to('recommendations', 200, path_id=_LAST)}
  when service = 'subscription' and method = 'POST' and plain = '/subscribe' then {_to('subscribe', 201)}
  when service = 'subscription' and method = 'GET' and starts_with(plain, '/subscription/')
    then {_to('subscription', 200, path_id=_LAST)}
  when service = 'notification' and method = 'POST' and plain = '/notify' then {_to('notify', 201)}
  when service = 'notification' and method = 'GET' and starts_with(plain, '/notifications/')
    then {_to('notifications', 200, path_id=_LAST)}
  else {_to('unknown', 404)} end as r
  from (select *, regexp_extract(path, '^([^?#]*)', 1) as plain from requests))
"""
_SQL["p8_routes"] = "select * from o_routes"
_SQL["p8_route_counts"] = (
    "select service, route, status, count(*) as n_requests from o_routes group by service, route, status"
)
_SQL["p9_playback_sessions"] = """
select seq, case when ok then user_id || '-' || media_id || '-' || (epoch_us(ts) // 1000) end as session_id,
  case when ok then 'http://localhost:8102/media/' || media_id || '/manifest.m3u8' end as playback_url,
  case when not ok then 'userId and mediaId are required' end as error
from (select *, coalesce(user_id, '') <> '' and coalesce(media_id, '') <> '' as ok from playback_requests)
"""

# ------------------------------------------------------------------ terms --

_SQL["t1_document_terms"] = f"select path, unnest({terms('content')}) as term from files_new"
_SQL["t2_stop_words"] = (
    f"select path, len({words('content')}) as n_words, len({terms('content')}) as n_terms from files_new"
)
_SQL["t3_code_terms"] = "select term from o_code_terms"
_SQL["t4_config_terms"] = "select term from o_config_terms"
_SQL["t5_change_terms"] = f"""
select distinct unnest({terms('txt')}) as term from (
  select key as txt from o_config_changes union select coalesce(old_value, 'None') from o_config_changes
  union select coalesce(new_value, 'None') from o_config_changes)
"""
_SQL["t6_service_mentions"] = "select path, service from o_mentions"
_SQL["t7_services_in_keys"] = " union ".join(
    f"select regexp_extract(key, '{p}([^.]*)', 1) as service from o_config_changes "
    f"where regexp_extract(key, '{p}([^.]*)', 1) <> ''"
    for p in services.KEY_PREFIXES
)
_SQL["t8_all_terms"] = "select term from o_all_terms"

# ---------------------------------------------------------- configuration --

_SQL["c1_flatten"] = """
select cast(event_id as varchar) as path, f.key, f.value, f.value_type from (select event_id, unnest([
  struct_pack(key := 'event.id', value := cast(event_id as varchar), value_type := 'int'),
  struct_pack(key := 'event.props.k', value := cast({K} as varchar), value_type := 'int'),
  struct_pack(key := 'event.by.user.id', value := cast(user_id as varchar), value_type := 'int'),
  struct_pack(key := 'type', value := event_type, value_type := 'string'),
  struct_pack(key := 'list', value := '[1,{{"a":2}}]', value_type := 'list')]) as f from events)
"""
for _key, _suffix in {
    "c2_yaml_facts": ".yaml", "c3_json_facts": ".json", "c5_xml_facts": ".xml", "c6_js_facts": ".config.js",
    "c7_env_facts": ".env",
}.items():
    _SQL[_key] = f"select path, key, value, value_type from o_facts_new where ends_with(path, '{_suffix}')"
_BOTH = (
    "(select path, content from config_new where ends_with(path, '.properties') "
    "union all select path, content from files_new where ends_with(path, '.properties'))"
)
_SQL["c4_properties_facts"] = property_facts(_BOTH, "('#', '!')", True, False)
_SQL["c8_config_facts"] = "select path, key, value, value_type from o_facts_new"
_SQL["c9_config_changes"] = "select path, key, old_value, old_type, new_value, new_type from o_config_changes"
_SQL["c10_manifest_services"] = """
select path, svc as service from config_new_values where format = 'yaml'
union all select path, 'peer' || (n % 10) || 'service' from config_new_values where format = 'yaml'
"""

# ------------------------------------------------------------ aggregation --

_SQL["a1_corpus_idf"] = "select term, df, round(idf, 6) as idf from o_idf"
_SQL["a2_affected_services"] = "select service from o_services"
_SQL["a3_dependency_edges"] = "select distinct test_id, config_key from config_access"
_SQL["a3_dependency_sizes"] = (
    "select test_id, count(distinct config_key) as n_keys from config_access group by test_id"
)
_SQL["a3_dependency_totals"] = """
select count(distinct test_id) as n_tests, count(distinct test_id || '|' || config_key) as n_dependencies
from config_access
"""
_SQL["a3_dependencies_of"] = """
select u.test_id, a.config_key
from (select distinct 'Test' || substr(user_id, 2) as test_id from all_users) u
left join (select distinct test_id, config_key from config_access) a on u.test_id = a.test_id
"""


def _case(column: str, table: dict[str, str], other: str) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {_text(v)}" for k, v in table.items()) + f" else {other} end"


_RUNNER = _case(ext("path"), selection.RUNNER_OF_EXTENSION, f"'unknown (' || {ext('path')} || ')'")
_SQL["a4_runner_groups"] = f"select {_RUNNER} as runner, path from all_paths"
_SQL["a4_runner_sizes"] = f"select {_RUNNER} as runner, count(*) as n_tests from all_paths group by 1"
_SQL["a5_extension_groups"] = f"""
select {_case(ext('path'), selection.EXTENSION_GROUPS, 'null')} as group_name, path from all_paths
where {is_test('path')} and not {is_skipped('path')} and {ext('path')} in {_list(selection.EXTENSION_GROUPS)}
"""


def _serves(p: str) -> str:
    tests = []
    for e, markers in selection.PROJECT_MARKERS.items():
        for m in markers:
            hit = f"ends_with({name(p)}, '{m[1:]}')" if m.startswith("*") else f"{name(p)} = '{m}'"
            tests.append(f"(t.ext = '{e}' and {hit})")
    return " or ".join(tests)


DUCK_VIEWS["o_root_files"] = "select path from files_new union all select path from marker_files"
DUCK_VIEWS["o_roots"] = f"""
select t.path, coalesce(arg_max(m.dir, length(m.dir)), any_value(t.dir)) as root
from (select path, {directory('path')} as dir, {ext('path')} as ext from o_root_files
      where {is_test('path')} and not {is_skipped('path')}) t
left join (select distinct path, {directory('path')} as dir from o_root_files) m
  on (m.dir = t.dir or m.dir = '' or starts_with(t.dir, m.dir || '/'))
  and len(list_filter(string_split(t.dir, '/'), lambda x: x <> '')) - len(list_filter(string_split(m.dir, '/'), lambda x: x <> '')) < 6
  and ({_serves('m.path')})
group by t.path
"""
_SQL["a6_root_groups"] = """
select root, case when root = '' then path else substr(path, length(root) + 2) end as relative_path from o_roots
"""
_SQL["a7_run_summary"] = """
select count(*) as changed_files, count(*) filter (category = 'source') as source_files,
  count(*) filter (category = 'config') as config_files,
  (select count(*) from o_tests) as total_tests_analyzed, (select count(*) from o_ranked) as affected_tests_count
from o_reviewed
"""

# ------------------------------------------------------------------ joins --

_SQL["j1_lexical_scores"] = "select path, round(lexical, 6) as lexical from o_lexical"
_SQL["j2_service_relevance"] = "select path, service_score from o_relevance"


def _reduced(p: str) -> str:
    out = f"lower({stem(p)})"
    for part in ["_service", "service", "_test", "test", "_spec", "spec"]:
        out = f"replace({out}, '{part}', '')"
    return out


_SQL["j3_filename_bonus"] = f"""
select t.path, cast(case when exists (
    select 1 from (select distinct {_reduced('path')} as w from o_reviewed) c where c.w <> '' and contains(t.n, c.w))
  then 0.3 else 0.0 end as double) as bonus
from (select path, {_reduced('path')} as n from o_tests) t
"""
_SQL["j4_selected_tests"] = """
select distinct test_id as test, config_key as setting from config_access
where config_key in (select config_key from changed_keys)
"""
_SQL["j4_tests_of_config_change"] = """
select distinct test_id as test, config_key as setting from config_reads
where config_key in (select key from o_config_changes)
"""
_MARKERS = ", ".join(
    f"({i}, {_text(m)}, {_text(lang)})" for i, (m, lang) in enumerate(selection.LANGUAGE_MARKERS.items())
)
_SQL["j5_languages"] = f"""
select root, string_agg(language, ', ' order by place) as languages from (
  select distinct {directory('f.path')} as root, k.place, k.language
  from marker_files f join (values {_MARKERS}) k(place, marker, language)
    on {name('f.path')} = k.marker
    or (starts_with(k.marker, '*') and ends_with({name('f.path')}, substr(k.marker, 2)))) group by root
"""
_SQL["j6_project_roots"] = "select path, root from o_roots"
_SQL["j7_login_audit"] = """
select a.seq, a.email, case when u.password_digest = a.password_digest then u.user_id end as user_id,
  case when u.password_digest = a.password_digest then 'token-' || u.user_id end as token,
  case when u.password_digest = a.password_digest then 200 else 401 end as status
from login_attempts a left join users u on a.email = u.email
"""
_SQL["j8_recommendations"] = """
select r.user_id, r.pos, r.media_id from recs r join all_users u on r.user_id = u.user_id
union all
select u.user_id, d.pos, d.media_id from all_users u cross join (values (0, 'm1'), (1, 'm2')) d(pos, media_id)
where u.user_id not in (select user_id from recs)
"""
_SQL["j9_movie_lookup"] = """
select r.seq, r.id, c.title, c.genre, c.year, case when c.id is null then 404 else 200 end as status
from movie_requests r left join catalog c on r.id = c.id
"""
DUCK_VIEWS["o_sent"] = """
select *, case when trim(user_id) = '' then 'userId is required'
    when channel not in ('email', 'sms', 'push') then 'Unsupported channel: ' || channel end as reason,
  sha256(seq || '|' || user_id || '|' || channel) as id
from notify_requests
"""
_SQL["j10_has_been_notified"] = """
select user_id, user_id in (select user_id from o_sent where reason is null) as notified from all_users
"""
_SQL["j11_failing_services"] = """
select service from expected_services where service not in (select service from probes where status = 200)
"""

# ---------------------------------------------------------------- ranking --

_SQL["r1_lexical_ranking"] = "select path, round(lexical, 6) as lexical from o_lexical_config where lexical >= 0.1"
_SQL["r2_combined_ranking"] = "select path, round(lexical, 6) as lexical, service_score, score from o_ranked"
_SQL["r3_extreme_terms"] = """
select side, term, df, round(idf, 6) as idf from (
  (select 'most distinctive' as side, * from o_idf order by idf desc, term limit 10)
  union all (select 'most common' as side, * from o_idf order by idf, term limit 10))
"""
_SQL["r4_newest_first"] = """
select user_id, seq, id as notification_id, channel, epoch_us(ts) as created_at_us
from o_sent where reason is null and user_id in (select user_id from all_users) order by user_id, ts desc, seq
"""

# ------------------------------------------------------------------- sets --

_SQL["u1_corpus_with_tests"] = f"""
select path from files_old where {is_source('path')} and not {is_skipped('path')} union select path from o_tests
"""
_SQL["u2_common_terms"] = "select term from o_code_terms intersect select term from o_test_terms"
_SQL["u3_key_union"] = "select path, key from o_facts_old union select path, key from o_facts_new"

# ------------------------------------------------------------ media folds --

_SQL["m1_catalogue"] = "select id, title, genre, year from catalog"
for _kind, _prefix in (("watchlist", "m2"), ("history", "m3")):
    _pos = f"""select user_id, row_number() over (partition by user_id order by seq) as pos, media_id
      from media_events where kind = '{_kind}'"""
    _SQL[f"{_prefix}_{_kind}_entries"] = _pos
    _SQL[f"{_prefix}_{_kind}_pages"] = f"""
    select u.user_id, coalesce(p.page, 0) as page, coalesce(p.media_ids, '') as media_ids
    from all_users u left join (select user_id, (pos - 1) // 10 as page, string_agg(media_id, ',' order by pos) as media_ids
      from ({_pos}) group by 1, 2) p on u.user_id = p.user_id
    """
_SQL["m4_subscriptions"] = """
with v as (select *, max(case when op = 'create' and plan <> 'Unknown' then seq end) over (partition by user_id) as cseq
  from sub_commands)
select user_id, arg_max(plan, seq) filter (op in ('create', 'upgrade') and plan <> 'Unknown') as plan_name,
  epoch_us(max(ts) filter (seq = cseq)) as started_at_us, epoch_us(arg_min(ts, seq) filter (op = 'cancel')) as cancelled_at_us,
  count(*) filter (op = 'cancel') = 0 as is_active
from v where seq >= cseq group by user_id
"""


def _last_write(events: str, column: str, default: str) -> str:
    return f"""select user_id, arg_max(coalesce({column}, '{default}'), seq) as {column} from {events} group by user_id"""


_SQL["m5_plans"] = f"""
select u.user_id, p.plan from all_users u left join ({_last_write('plan_writes', 'plan', 'basic')}) p
  on u.user_id = p.user_id
"""
_SQL["m6_send_results"] = """
select seq, user_id, channel, reason, case when reason is null then id end as notification_id,
  case when reason is null then epoch_us(ts) end as sent_at_us, reason is null as is_sent from o_sent
"""
_SQL["m4_subscription_lookup"] = f"""
select cast(c.c_custkey as bigint) as user_id, s.plan_name, s.started_at_us, s.cancelled_at_us, s.is_active
from (select distinct c_custkey from customer) c left join ({_SQL["m4_subscriptions"]}) s on s.user_id = c.c_custkey
"""
_SQL["m7_notification_lookup"] = """
select a.id as notification_id, s.seq, s.channel, s.body, epoch_us(s.ts) as created_at_us
from (select distinct user_id || '/email' as id from all_users) a
left join (select *, user_id || '/' || channel as saved_id from o_sent where reason is null
           qualify row_number() over (partition by user_id, channel order by seq desc) = 1) s on s.saved_id = a.id
"""
_SQL["m7_notifications_by_id"] = """
select id as notification_id, user_id, channel, subject, body, epoch_us(ts) as created_at_us, true as is_sent
from o_sent where reason is null
"""
_SQL["m8_channels"] = f"""
select u.user_id, p.channel from all_users u left join ({_last_write('channel_writes', 'channel', 'email')}) p
  on u.user_id = p.user_id
"""
_SQL["m9_command_results"] = """
select seq, user_id, op, plan, case
  when op in ('create', 'upgrade') and plan = 'Unknown' then 'Unknown plan: ' || plan
  when op in ('cancel', 'upgrade') and coalesce(creates, 0) = 0 then 'No subscription found for user: ' || user_id end as reason
from (select *, count(*) filter (op = 'create' and plan <> 'Unknown')
    over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as creates from sub_commands)
"""

# ---------------------------------------------------------------- streams --

_SQL["st1_subscription_stream"] = _SQL["m4_subscriptions"]
_SQL["st1_command_results"] = _SQL["m9_command_results"]
_SQL["st2_dependency_edge_stream"] = _SQL["a3_dependency_edges"]
_SQL["st3_plan_stream"] = _last_write("plan_writes", "plan", "basic")
_SQL["st3_channel_stream"] = _last_write("channel_writes", "channel", "email")

ORACLE: dict[str, str] = {key: duck(text) for key, text in _SQL.items()}
