"""Inputs of the operators, derived from the given tables.

Each view is one SELECT over the whole of its table, written once for Spark
and DuckDB; the few spellings that differ are the {…} fields. The views
say which file, event or user a row stands for; none of them samples. The
newer corpus holds every document; the older one lacks what was added since
and has other names for what was moved. A view of one kind of event leaves
the other kinds out.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ripplemark.session import stage

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SPARK = {
    "K": "cast(get_json_object(props, '$.k') as int)",
    "sha": "sha2(%s, 256)",
    "ts": "cast(ts as timestamp)",
}
DUCK = {
    "K": "cast(json_extract_string(props, '$.k') as int)",
    "sha": "sha256(%s)",
    "ts": "ts",
}

# In the texts: NL is a line feed, SQ a single quote, {K} the number of an event.
VIEWS: dict[str, str] = {}

# Every document is a file. Its language decides the file's type, its length
# its place: tests, config or source directory.
VIEWS["corpus_base"] = """
select doc_id, source, lang, n_chars,
  'services/' || source || '-service/' ||
  case when n_chars % 4 = 1 then 'config/doc' || doc_id || '.properties'
       when n_chars % 4 = 0 and lang = 'en' then 'tests/test_doc' || doc_id || '.py'
       when n_chars % 4 = 0 and lang = 'fr' then 'tests/doc' || doc_id || '.spec.js'
       when n_chars % 4 = 0 and lang = 'de' then 'src/test/java/Doc' || doc_id || 'Test.java'
       when n_chars % 4 = 0 then 'tests/Doc' || doc_id || 'Tests.cs'
       when lang = 'en' then 'src/doc' || doc_id || '.py'
       when lang = 'fr' then 'src/doc' || doc_id || '.js'
       when lang = 'de' then 'src/main/java/Doc' || doc_id || '.java'
       else 'src/doc' || doc_id || '_handler.cs' end as path,
  case when n_chars % 4 = 1
       then 'serviceName=' || source || '-service' || NL || 'retries=3' || NL || text
       when n_chars % 4 = 0
       then text || NL || 'from src' || (n_chars % 23) || ' import client' || NL
            || 'GET http://host/src' || (n_chars % 29) || '-service/items' || NL
       else text end as body,
  source in ('src1', 'src2') and n_chars % 4 <> 0 as touched
from documents
"""
# Files of one source and language appear with the newer revision only, of
# another with the older one only.
VIEWS["files_old"] = """
select case when source = 'src4' and lang = 'de' then 'legacy/' || path else path end as path,
  case when n_chars % 4 = 1 then 'port=8000' || NL || body else body end as content
from corpus_base where not (source = 'src3' and lang <> 'en')
"""
VIEWS["files_new"] = """
select path,
  case when n_chars % 4 = 1 then (case when touched then 'port=8121' else 'port=8000' end) || NL || body
         || case when touched then NL || 'app: checkoutservice' || NL || 'name: doc' || (doc_id - 1) || 'service' || NL else '' end
       when touched then body || NL || 'payment_total = 1' || NL
       else body end as content
from corpus_base
"""
# A later revision that moves files: some as they are, some with a new line, some with a new name too.
VIEWS["files_moved"] = """
select case when path like '%.py' then replace(path, '/src/doc', '/lib/module')
       else replace(replace(path, '/src/test/java/', '/src/it/java/'), '/src/main/java/', '/src/java/') end as path,
  case when path like '%/src/main/java/%' or path like '%/src/doc%.py' then 'moved = 1' || NL || content else content end as content
from files_new
"""
# A directory of every source with a marker file of some kind, and the root.
VIEWS["marker_files"] = """
select distinct case when source = 'src9' then '' else 'services/' || source || '-service/' end ||
  case when lang = 'en' and source in ('src1', 'src2', 'src3') then 'pom.xml'
       when lang = 'en' then 'requirements.txt'
       when lang = 'fr' then 'package.json'
       when lang = 'de' then 'src/test/pom.xml'
       else source || '.csproj' end as path
from documents
"""
# Every event is a configuration file; its type decides the format.
CONFIG_TEXT = """
select event_id,
  'services/svc' || (user_id % 8) || '-service/config/app' || event_id ||
  case event_type when 'signup' then '.json' when 'purchase' then '.properties'
       when 'click' then '.config.js' when 'view' then '.env'
       else case when user_id % 2 = 0 then '.yaml' else '.xml' end end as path,
  'svc' || (user_id % 8) || 'service' as svc,
  case event_type when 'signup' then 'json' when 'purchase' then 'properties' when 'click' then 'js'
       when 'view' then 'env' else case when user_id % 2 = 0 then 'yaml' else 'xml' end end as format,
  event_type as owner,
  {n} as n
from events
"""
VIEWS["config_old_values"] = CONFIG_TEXT.replace("{n}", "{K}")
VIEWS["config_new_values"] = CONFIG_TEXT.replace("{n}", "{K} + case when value > 20 then 1 else 0 end")
CONFIG_DOCS = """
select path,
  case format
    when 'json' then '{{"server":{{"timeout":' || n || ',"retry":{{"attempts":3}},"tags":["a",1],"none":{{}}}},"owner":"'
      || owner || '","rate":' || n || '.5,"on":true,"off":null}}'
    when 'properties' then '# c' || NL || '! d' || NL || 'server.timeout = ' || n || NL || 'owner : ' || owner
      || NL || 'owner=' || owner || '=' || n || NL || 'broken line' || NL
    when 'js' then '// head' || NL || 'module.exports = {{ timeout: ' || n || ', owner: ' || SQ || owner || SQ
      || ', nested: {{ rate: ' || n || '.50, debug: true, old: null }}, /* gone: 1 */ "quoted": 2 }};' || NL
    when 'env' then '# c' || NL || 'TIMEOUT=' || n || NL || 'OWNER="' || owner || '"' || NL || 'PAIR=a=' || n
    when 'yaml' then 'kind: Deployment' || NL || 'metadata:' || NL || '  name: ' || svc || NL || 'spec:' || NL
      || '  replicas: ' || n || NL || '  template:' || NL || '    spec:' || NL || '      containers:' || NL
      || '        - name: main' || NL || '          env:' || NL || '            - name: PEER' || NL
      || '              value: "peer' || (n % 10) || 'service:80"' || NL || '---' || NL || 'debug: true' || NL
      || 'owner: ' || owner || NL
    else '<config mode="x"><server><timeout> ' || n || ' </timeout></server><owner>' || owner
      || '</owner><empty/></config>' end as content
from {values}
"""
VIEWS["config_old"] = CONFIG_DOCS.replace("{values}", "config_old_values")
VIEWS["config_new"] = CONFIG_DOCS.replace("{values}", "config_new_values")

VIEWS["sub_commands"] = """
select event_id as seq, {ts} as ts, user_id,
  case event_type when 'signup' then 'create' when 'purchase' then 'upgrade' else 'cancel' end as op,
  case {K} % 4 when 0 then 'Basic' when 1 then 'Premium' when 2 then 'Enterprise' else 'Unknown' end as plan
from events where event_type in ('signup', 'purchase', 'error')
"""
VIEWS["plan_writes"] = """
select event_id as seq, 'u' || user_id as user_id,
  case {K} % 3 when 0 then 'premium' when 1 then 'trial' end as plan
from events
"""
VIEWS["channel_writes"] = """
select event_id as seq, 'u' || user_id as user_id,
  case {K} % 4 when 0 then 'sms' when 1 then 'push' when 2 then 'fax' end as channel
from events
"""
VIEWS["media_events"] = """
select event_id as seq, 'u' || user_id as user_id,
  case event_type when 'click' then 'watchlist' else 'history' end as kind, 'm' || {K} as media_id
from events where event_type in ('view', 'click')
"""
VIEWS["playback_requests"] = """
select event_id as seq, {ts} as ts, case when {K} = 13 then '' else 'u' || user_id end as user_id,
  case when {K} <> 17 then 'm' || {K} end as media_id
from events where event_type = 'view'
"""
VIEWS["catalog"] = """
select 'm' || p_partkey as id, p_name as title, p_type as genre, 1950 + p_size as year from part
"""
VIEWS["notify_requests"] = """
select event_id as seq, {ts} as ts, case when {K} = 13 then '   ' else 'u' || user_id end as user_id,
  case {K} % 4 when 0 then 'email' when 1 then 'sms' when 2 then 'push' else 'carrier_pigeon' end as channel,
  event_type as subject, props as body
from events
"""
# Customers of four segments have an account, all customers may ask.
VIEWS["users"] = """
select 'user' || c_custkey || '@example.com' as email, {sha:'pw' || c_custkey} as password_digest,
  'u' || c_custkey as user_id
from customer where c_mktsegment <> 'BUILDING'
"""
VIEWS["all_users"] = "select 'u' || c_custkey as user_id from customer"
VIEWS["login_attempts"] = """
select event_id as seq, 'user' || user_id || '@example.com' as email,
  {sha:case when {K} % 5 = 0 then 'wrong' else 'pw' || user_id end} as password_digest
from events
"""
VIEWS["recs"] = """
select 'u' || user_id as user_id, min(event_id) as pos, 'm' || {K} as media_id
from events where event_type = 'purchase' group by user_id, {K}
"""
VIEWS["config_access"] = """
select {ts} as ts, 'Test' || user_id as test_id, event_type || '.k' || {K} as config_key from events
"""
VIEWS["config_reads"] = """
select 'Test' || user_id as test_id, case event_type when 'signup' then 'server.timeout'
  when 'purchase' then 'server.tags' when 'click' then 'timeout' when 'view' then 'OWNER'
  else 'Deployment/svc' || (user_id % 8) || 'service.spec.replicas' end as config_key
from events
"""
VIEWS["changed_keys"] = """
select distinct event_type || '.k' || {K} as config_key from events where value > 250
"""
VIEWS["requests"] = """
select event_id as seq,
  case {K} % 8 when 0 then 'catalog' when 1 then 'streaming' when 2 then 'auth' when 3 then 'recommendation'
    when 4 then 'watchlist' when 5 then 'history' when 6 then 'subscription' else 'notification' end as service,
  case event_type when 'view' then 'GET' when 'click' then 'GET' when 'error' then 'DELETE' else 'POST' end as method,
  case when value < 2 then '/health' when value < 4 then '/movies'
    when value > 200 then '/nowhere/' || user_id
    else case {K} % 8 when 0 then '/movies/m' || {K} || '?lang=en' when 1 then '/stream/start' when 2 then '/login'
      when 3 then '/recommendations/u' || user_id
      when 4 then '/watchlist?page=1&userId=u' || user_id when 5 then '/history?userId=a%20' || user_id || '&userId=b'
      when 6 then case event_type when 'view' then '/subscription/u' || user_id else '/subscribe' end
      else case event_type when 'click' then '/notifications/u' || user_id else '/notify' end end end as path
from events
"""
VIEWS["request_bodies"] = """
select event_id as seq,
  case event_type when 'signup' then '{{"userId":"u' || user_id || '"}}'
    when 'purchase' then '{{"userId": "u' || user_id || '", "plan": "Premium", "extra": 1}}'
    when 'view' then '{{"plan":"Basic"}}' when 'click' then '{{"userId":"u' || user_id else '' end as body
from events
"""
VIEWS["movie_requests"] = "select event_id as seq, 'm' || ({K} * 37) as id from events"
VIEWS["probes"] = """
select event_id as seq, event_type || '-service' as service, case when event_type = 'error' then 500 else 200 end as status
from events
"""
# Paths of every kind: the corpus, its markers, configuration, and one per part.
VIEWS["part_paths"] = """
select case p_size % 12
  when 0 then 'web/node_modules/lib' || p_partkey || '/index.js'
  when 1 then 'build-tools/out' || p_partkey || '.pyc'
  when 2 then 'docs/README' || p_partkey || '.md'
  when 3 then 'apps/' || lower(p_type) || '/settings' || p_partkey || '.py'
  when 4 then 'svc' || p_partkey || '-api/src/index.js'
  when 5 then 'tests/spec_item' || p_partkey || '_service_test.rb'
  when 6 then './Driver' || p_partkey || '_Service/SRC/app.v2.JAVA'
  when 7 then 'part' || p_partkey || '.env'
  when 8 then 'a' || p_partkey || '/.ENV'
  when 9 then 'images/latest' || p_partkey || '.ts'
  when 10 then 'main/conf/Order' || p_partkey || '.settings'
  else 'src/service' || p_partkey || '/__init__.py' end as path
from part
"""
VIEWS["all_paths"] = """
select path from files_new union all select path from marker_files
union all select path from config_new union all select path from part_paths
"""
VIEWS["expected_services"] = """
select distinct service from probes union all select 'search-service' as service
"""


def _render(text: str, dialect: dict[str, str]) -> str:
    text = text.replace("{K}", dialect["K"]).replace("{ts}", dialect["ts"])
    text = re.sub(r"\{sha:((?:[^{}])*)\}", lambda m: dialect["sha"] % m.group(1), text)
    text = text.replace("{{", "{").replace("}}", "}")
    return re.sub(r"\bNL\b", "chr(10)", re.sub(r"\bSQ\b", "chr(39)", text)).strip()


# Further views of the DuckDB side only; checks.oracle fills them.
DUCK_VIEWS: dict[str, str] = {}


def _text(name: str) -> str:
    return VIEWS.get(name) or DUCK_VIEWS[name]


def _needs(text: str) -> list[str]:
    return [v for v in [*VIEWS, *DUCK_VIEWS] if re.search(rf"\b(?:from|join)\s+{v}\b", text)]


@cache
def _closure(name: str) -> tuple[str, ...]:
    order: list[str] = []
    for v in _needs(_text(name)):
        order += [x for x in _closure(v) if x not in order]
    return (*order, name)


# Corpora are tables in their own right: written once per session and input,
# then read like any stored corpus, with columns and sizes known to the planner.
STORED = ("files_old", "files_new", "files_moved", "config_old", "config_new")
# The corpora of texts are as large as their table and cost one concatenation a file, so they are read from it directly
# where its scan has a task for every core; no text is then shuffled or written again.
TEXTS = ("files_old", "files_new", "files_moved")
_stored: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the parquet tables of ``sf_dir``."""
    if name not in STORED:
        return _build(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        built = _build(spark, sf_dir, name)
        _stored[key] = built if name in TEXTS and _in_enough_tasks(spark, sf_dir) else stage(built.repartition("path"), name)
    return _stored[key]


def _in_enough_tasks(spark: SparkSession, sf_dir: str) -> bool:
    return table(spark, sf_dir, "documents")._jdf.queryExecution().toRdd().getNumPartitions() >= spark.sparkContext.defaultParallelism


def _build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _render(VIEWS[name], SPARK)
    used: dict[str, DataFrame] = {}
    for source in [*_needs(text), *(t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", text))]:
        used[source] = view(spark, sf_dir, source) if source in VIEWS else table(spark, sf_dir, source)
        text = re.sub(rf"\b(from|join)\s+{source}\b", rf"\1 {{{source}}}", text)
    return _sql(spark, text, used)


def _sql(spark: SparkSession, text: str, used: dict[str, DataFrame]) -> DataFrame:
    # literal braces of the SQL survive the format step as doubled braces
    slots = "|".join(map(re.escape, used))
    escaped = text.replace("{", "{{").replace("}", "}}")
    escaped = re.sub(r"\{\{(" + slots + r")\}\}", r"{\1}", escaped)
    return spark.sql(escaped, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(sql: str) -> str:
    """DuckDB SQL with the views it uses put in front as WITH clauses."""
    order: list[str] = []
    for v in _needs(sql):
        order += [x for x in _closure(v) if x not in order]
    views = ",\n".join(f"{v} as materialized ({_render(_text(v), DUCK)})" for v in order)
    body = _render(sql, DUCK)
    if not views:
        return body
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"
