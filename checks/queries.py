"""One Spark query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import table, view
from ripplemark.functions import http
from ripplemark.functions import paths as P
from ripplemark.functions import words as W
from ripplemark.operators import configs, folds, lookups, scoring, selection, services, terms
from ripplemark.plans import config_selection, impact
from ripplemark.session import stage, stage_path
from ripplemark.sources import bodies, corpus, reports
from ripplemark.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _us(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")).alias(f"{column}_us")


def _revisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf, "files_old"), view(spark, sf, "files_new")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return stage(corpus.reviewable(corpus.changed_files(*_revisions(spark, sf))), "changes")


def _config_lines(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _revisions(spark, sf)
    return corpus.changed_lines(old, new, _changes(spark, sf).filter("category = 'config'"))


def _facts(spark: SparkSession, sf: str, revision: str) -> DataFrame:
    return configs.config_facts(view(spark, sf, revision))


def _facts_of(spark: SparkSession, sf: str, suffix: str) -> DataFrame:
    files = view(spark, sf, "config_new").filter(F.col("path").endswith(suffix))
    return configs.config_facts(files)


def _config_revisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf, "config_old"), view(spark, sf, "config_new")


def _impact(spark: SparkSession, sf: str) -> impact.ImpactRun:
    return impact.analyze(*_revisions(spark, sf))


# ------------------------------------------------------ sources and sinks --


@query
def s1_corpus_scan(spark, sf):
    files = view(spark, sf, "files_new")
    whole = corpus.with_tests(corpus.corpus_files(files), corpus.find_tests(files))
    return whole.select("path", F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query
def s2_change_set(spark, sf):
    return corpus.changed_files(*_revisions(spark, sf))


@query
def s2_renames(spark, sf):
    return corpus.change_set(view(spark, sf, "files_new"), view(spark, sf, "files_moved"))


@query
def s3_changed_lines(spark, sf):
    old, new = _revisions(spark, sf)
    return corpus.changed_lines(old, new, _changes(spark, sf))


@query
def s4_result_entries(spark, sf):
    run = _impact(spark, sf)
    path = stage_path(spark, "report")
    reports.write_report(run.entries(), run.summary(), path)
    return reports.read_report(spark, path).select("section", "path", F.round("score", 6).alias("score"))


@query
def s5_result_summary(spark, sf):
    run = _impact(spark, sf)
    path = stage_path(spark, "report")
    reports.write_report(run.entries(), run.summary(), path)
    return reports.report_summary(reports.read_report(spark, path), run.tests)


@query
def s6_request_bodies(spark, sf):
    read = bodies.read_bodies(view(spark, sf, "request_bodies"), {"userId": "", "plan": "basic"})
    return read.select("seq", "rejected", F.col("userId").alias("user_id"), "plan")


# ------------------------------------------------------------------ paths --


def _paths(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return view(spark, sf, "all_paths").select("path", *[c.alias(n) for n, c in columns.items()])


@query
def p1_file_names(spark, sf):
    return _paths(
        spark, sf, name=P.file_name("path"), stem=P.stem("path"), ext=P.extension("path"), dir=P.directory("path")
    )


@query
def p2_config_files(spark, sf):
    return _paths(spark, sf, is_config=P.is_config_file("path"))


@query
def p3_source_files(spark, sf):
    return _paths(spark, sf, is_source=P.is_source_file("path"))


@query
def p4_test_files(spark, sf):
    return _paths(spark, sf, is_test=P.is_test_file("path"))


@query
def p5_categories(spark, sf):
    return _paths(spark, sf, category=P.category("path"))


@query
def p6_path_exclusion(spark, sf):
    return _paths(spark, sf, is_artifact=P.is_artifact("path"), is_skipped=P.is_skipped_by_scan("path"))


@query
def p7_service_names(spark, sf):
    return _paths(spark, sf, service=P.service_name("path"))


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    routed = http.route(F.col("service"), F.col("method"), F.col("path"))
    return view(spark, sf, "requests").select("seq", "service", "method", "path", routed.alias("r"))


@query
def p8_routes(spark, sf):
    return _routes(spark, sf).select("seq", "service", "r.route", "r.path_id", "r.status", "r.miss_status")


@query
def p8_route_counts(spark, sf):
    return _routes(spark, sf).groupBy("service", "r.route", "r.status").agg(F.count("*").alias("n_requests"))


@query
def p9_playback_sessions(spark, sf):
    session = http.playback_session(F.col("user_id"), F.col("media_id"), F.col("ts"))
    return view(spark, sf, "playback_requests").select("seq", session.alias("s")).select("seq", "s.*")


@query
def p10_query_parameters(spark, sf):
    return view(spark, sf, "requests").select(
        "seq", http.query_parameter(F.col("path"), "userId").alias("user_id")
    )


# ------------------------------------------------------------------ terms --


@query
def t1_document_terms(spark, sf):
    return terms.term_rows(view(spark, sf, "files_new"))


@query
def t2_stop_words(spark, sf):
    return view(spark, sf, "files_new").select(
        "path",
        F.size(F.array_remove(W.all_words("content"), "")).cast("bigint").alias("n_words"),
        F.size(W.terms("content")).cast("bigint").alias("n_terms"),
    )


def _changed_of(spark: SparkSession, sf: str, category: str) -> DataFrame:
    changed = _changes(spark, sf).filter(F.col("category") == category).select("path")
    return view(spark, sf, "files_new").join(changed, "path", "left_semi")


@query
def t3_code_terms(spark, sf):
    return terms.distinct_terms(_changed_of(spark, sf, "source"))


def _config_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms.key_terms(configs.config_facts(_changed_of(spark, sf, "config")))


@query
def t4_config_terms(spark, sf):
    return _config_terms(spark, sf)


@query
def t5_change_terms(spark, sf):
    return terms.change_terms(configs.distinct_changes(*_config_revisions(spark, sf)))


@query
def t6_service_mentions(spark, sf):
    return services.service_mentions(_config_lines(spark, sf))


@query
def t7_services_in_keys(spark, sf):
    return services.services_in_keys(configs.distinct_changes(*_config_revisions(spark, sf)))


@query
def t8_all_terms(spark, sf):
    return terms.union_terms(terms.distinct_terms(_changed_of(spark, sf, "source")), _config_terms(spark, sf))


# ---------------------------------------------------------- configuration --


@query
def c1_flatten(spark, sf):
    nested = F.concat(
        F.lit('{"event":{"id":'), "event_id", F.lit(',"props":'), "props", F.lit(',"by":{"user":{"id":'),
        "user_id", F.lit('}}},"type":"'), "event_type", F.lit('","list":[1,{"a":2}],"empty":{}}'),
    )
    events = table(spark, sf, "events").repartition("event_id")
    texts = events.select(F.col("event_id").cast("string").alias("path"), nested.alias("content"))
    return configs.flatten_json(texts)


@query
def c2_yaml_facts(spark, sf):
    return _facts_of(spark, sf, ".yaml")


@query
def c3_json_facts(spark, sf):
    return _facts_of(spark, sf, ".json")


@query
def c4_properties_facts(spark, sf):
    files = view(spark, sf, "config_new").unionByName(view(spark, sf, "files_new"))
    return configs.config_facts(files.filter(F.col("path").endswith(".properties")))


@query
def c5_xml_facts(spark, sf):
    return _facts_of(spark, sf, ".xml")


@query
def c6_js_facts(spark, sf):
    return _facts_of(spark, sf, ".config.js")


@query
def c7_env_facts(spark, sf):
    return _facts_of(spark, sf, ".env")


@query
def c8_config_facts(spark, sf):
    return _facts(spark, sf, "config_new")


@query
def c9_config_changes(spark, sf):
    return configs.file_changes(*_config_revisions(spark, sf))


@query
def c10_manifest_services(spark, sf):
    return configs.manifest_services(view(spark, sf, "config_new"))


# ------------------------------------------------------------ aggregation --


def _idf(spark: SparkSession, sf: str) -> DataFrame:
    return terms.corpus_idf(corpus.corpus_files(view(spark, sf, "files_new")))


@query
def a1_corpus_idf(spark, sf):
    return _idf(spark, sf).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def a2_affected_services(spark, sf):
    return services.affected_services(
        _changes(spark, sf), _config_lines(spark, sf), view(spark, sf, "files_new")
    )


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return selection.dependency_edges(view(spark, sf, "config_access"))


@query
def a3_dependency_edges(spark, sf):
    return _edges(spark, sf)


@query
def a3_dependency_sizes(spark, sf):
    return selection.dependency_sizes(_edges(spark, sf))


@query
def a3_dependency_totals(spark, sf):
    return selection.dependency_totals(_edges(spark, sf))


@query
def a3_dependencies_of(spark, sf):
    asked = view(spark, sf, "all_users").select(F.concat(F.lit("Test"), F.substring("user_id", 2, 20)).alias("test_id"))
    return selection.dependencies_of(_edges(spark, sf), asked)


@query
def a4_runner_groups(spark, sf):
    return selection.group_by_runner(view(spark, sf, "all_paths"))


@query
def a4_runner_sizes(spark, sf):
    return selection.group_sizes(selection.group_by_runner(view(spark, sf, "all_paths")), "runner")


@query
def a5_extension_groups(spark, sf):
    return selection.group_by_extension(corpus.find_tests(view(spark, sf, "all_paths")))


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files_new").select("path").unionByName(view(spark, sf, "marker_files"))
    return selection.project_roots(corpus.find_tests(files), files)


@query
def a6_root_groups(spark, sf):
    return selection.group_by_root(_roots(spark, sf))


@query
def a7_run_summary(spark, sf):
    run = _impact(spark, sf)
    return selection.run_summary(run.changes, run.tests, run.ranked)


# ------------------------------------------------------------------ joins --


def _lexical(spark: SparkSession, sf: str, changed: DataFrame, idf: DataFrame | None) -> DataFrame:
    tests = corpus.find_tests(view(spark, sf, "files_new"))
    distinctive = terms.distinctive_terms(changed, idf)
    return scoring.lexical_scores(terms.term_rows(tests), tests, distinctive)


@query
def j1_lexical_scores(spark, sf):
    scores = _lexical(spark, sf, t8_all_terms(spark, sf), _idf(spark, sf))
    return scores.select("path", F.round("lexical", 6).alias("lexical"))


@query
def j2_service_relevance(spark, sf):
    tests = corpus.find_tests(view(spark, sf, "files_new"))
    return scoring.service_relevance(tests, a2_affected_services(spark, sf))


@query
def j3_filename_bonus(spark, sf):
    tests = corpus.find_tests(view(spark, sf, "files_new"))
    return scoring.filename_bonus(_changes(spark, sf), tests)


@query
def j4_selected_tests(spark, sf):
    return selection.select_by_config(_edges(spark, sf), view(spark, sf, "changed_keys"))


@query
def j4_tests_of_config_change(spark, sf):
    return config_selection.tests_of_config_change(
        view(spark, sf, "config_old"), view(spark, sf, "config_new"), view(spark, sf, "config_reads")
    )


@query
def j5_languages(spark, sf):
    found = selection.detect_languages(view(spark, sf, "marker_files"))
    return found.select("root", F.array_join("languages", ", ").alias("languages"))


@query
def j6_project_roots(spark, sf):
    return _roots(spark, sf)


@query
def j7_login_audit(spark, sf):
    return lookups.login_audit(view(spark, sf, "login_attempts"), view(spark, sf, "users"))


@query
def j8_recommendations(spark, sf):
    return lookups.recommendations(view(spark, sf, "recs"), view(spark, sf, "all_users"))


@query
def j9_movie_lookup(spark, sf):
    return lookups.movie_lookup(view(spark, sf, "movie_requests"), view(spark, sf, "catalog"))


@query
def j10_has_been_notified(spark, sf):
    saved = folds.notifications(folds.send_results(view(spark, sf, "notify_requests")))
    return lookups.has_been_notified(view(spark, sf, "all_users"), saved)


@query
def j11_failing_services(spark, sf):
    return lookups.failing_services(view(spark, sf, "expected_services"), view(spark, sf, "probes"))


# ---------------------------------------------------------------- ranking --


@query
def r1_lexical_ranking(spark, sf):
    ranked = scoring.rank_lexical(_lexical(spark, sf, _config_terms(spark, sf), None))
    return ranked.select("path", F.round("lexical", 6).alias("lexical"))


@query
def r2_combined_ranking(spark, sf):
    ranked = _impact(spark, sf).ranked
    return ranked.select("path", F.round("lexical", 6).alias("lexical"), "service_score", "score")


@query
def r3_extreme_terms(spark, sf):
    return terms.extreme_terms(_idf(spark, sf)).select("side", "term", "df", F.round("idf", 6).alias("idf"))


@query
def r4_newest_first(spark, sf):
    saved = folds.notifications(folds.send_results(view(spark, sf, "notify_requests")))
    return folds.newest_first(saved, view(spark, sf, "all_users")).select(
        "user_id", "seq", "notification_id", "channel", _us("created_at")
    )


# ------------------------------------------------------------------- sets --


@query
def u1_corpus_with_tests(spark, sf):
    base = corpus.corpus_files(view(spark, sf, "files_old")).select("path")
    return corpus.with_tests(base, corpus.find_tests(view(spark, sf, "files_new")).select("path"))


@query
def u2_common_terms(spark, sf):
    tests = corpus.find_tests(view(spark, sf, "files_new"))
    return terms.common_terms(terms.distinct_terms(_changed_of(spark, sf, "source")), terms.distinct_terms(tests))


@query
def u3_key_union(spark, sf):
    return configs.key_union(_facts(spark, sf, "config_old"), _facts(spark, sf, "config_new"))


# ------------------------------------------------------------ media folds --


@query
def m1_catalogue(spark, sf):
    return lookups.catalogue(view(spark, sf, "catalog"))


def _entries(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return folds.media_entries(view(spark, sf, "media_events").filter(F.col("kind") == kind))


def _pages(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    pages = folds.media_pages(_entries(spark, sf, kind), view(spark, sf, "all_users"), page=10)
    return pages.select("user_id", "page", F.array_join("media_ids", ",").alias("media_ids"))


@query
def m2_watchlist_entries(spark, sf):
    return _entries(spark, sf, "watchlist")


@query
def m2_watchlist_pages(spark, sf):
    return _pages(spark, sf, "watchlist")


@query
def m3_history_entries(spark, sf):
    return _entries(spark, sf, "history")


@query
def m3_history_pages(spark, sf):
    return _pages(spark, sf, "history")


def _subscriptions(current: DataFrame) -> DataFrame:
    return current.select("user_id", "plan_name", _us("started_at"), _us("cancelled_at"), "is_active")


@query
def m4_subscriptions(spark, sf):
    return _subscriptions(folds.subscriptions(view(spark, sf, "sub_commands")))


@query
def m4_subscription_lookup(spark, sf):
    """Every customer asks, most of them without a subscription."""
    asked = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("user_id"))
    return _subscriptions(folds.subscription_of(folds.subscriptions(view(spark, sf, "sub_commands")), asked))


@query
def m5_plans(spark, sf):
    plans = folds.plan_preferences(view(spark, sf, "plan_writes"))
    return folds.preference_of(plans, view(spark, sf, "all_users"))


@query
def m6_send_results(spark, sf):
    return folds.send_results(view(spark, sf, "notify_requests")).select(
        "seq", "user_id", "channel", "reason", "notification_id", _us("sent_at"), "is_sent"
    )


@query
def m7_notifications_by_id(spark, sf):
    saved = folds.notifications(folds.send_results(view(spark, sf, "notify_requests")))
    return folds.notifications_by_id(saved).select(
        "notification_id", "user_id", "channel", "subject", "body", _us("created_at"), "is_sent"
    )


@query
def m7_notification_lookup(spark, sf):
    """A notification is saved under the id of its user and channel, so ids repeat; some asked ids were never saved."""
    sent = folds.notifications(folds.send_results(view(spark, sf, "notify_requests")))
    saved = sent.withColumn("notification_id", F.concat_ws("/", "user_id", "channel"))
    asked = view(spark, sf, "all_users").select(F.concat("user_id", F.lit("/email")).alias("notification_id"))
    return folds.notifications_by_id(saved, asked).select("notification_id", "seq", "channel", "body", _us("created_at"))


@query
def m8_channels(spark, sf):
    channels = folds.channel_preferences(view(spark, sf, "channel_writes"))
    return folds.preference_of(channels, view(spark, sf, "all_users"))


@query
def m9_command_results(spark, sf):
    return folds.command_results(view(spark, sf, "sub_commands"))


# ---------------------------------------------------------------- streams --


def _event_stream(spark: SparkSession, sf: str, columns: str, where: str = "true") -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    number = "cast(get_json_object(props, '$.k') as int)"
    return stream.filter(where).selectExpr(*[c.strip().replace("{K}", number) for c in columns.split(";")])


def _command_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _event_stream(
        spark, sf,
        "event_id as seq; ts; user_id;"
        "case event_type when 'signup' then 'create' when 'purchase' then 'upgrade' else 'cancel' end as op;"
        "case {K} % 4 when 0 then 'Basic' when 1 then 'Premium' when 2 then 'Enterprise' else 'Unknown' end as plan",
        "event_type in ('signup', 'purchase', 'error')",
    )


@query
def st1_subscription_stream(spark, sf):
    return _subscriptions(streams.subscription_stream(_command_stream(spark, sf)))


@query
def st1_command_results(spark, sf):
    return streams.command_result_stream(_command_stream(spark, sf))


@query
def st2_dependency_edge_stream(spark, sf):
    access = _event_stream(
        spark, sf, "'Test' || user_id as test_id; event_type || '.k' || {K} as config_key"
    )
    return streams.dependency_edge_stream(access)


@query
def st3_plan_stream(spark, sf):
    writes = _event_stream(
        spark, sf,
        "event_id as seq; 'u' || user_id as user_id;"
        "case {K} % 3 when 0 then 'premium' when 1 then 'trial' end as plan",
    )
    return streams.last_write_stream(writes, "user_id", "plan", folds.DEFAULT_PLAN)


@query
def st3_channel_stream(spark, sf):
    writes = _event_stream(
        spark, sf,
        "event_id as seq; 'u' || user_id as user_id;"
        "case {K} % 4 when 0 then 'sms' when 1 then 'push' when 2 then 'fax' end as channel",
    )
    return streams.last_write_stream(writes, "user_id", "channel", folds.DEFAULT_CHANNEL)
