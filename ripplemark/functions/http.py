"""Requests to the media services: routes, query parameters, bodies, playback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the playback address and request defaults ----
PLAYBACK_URL = ("http://localhost:8102/media/", "/manifest.m3u8")
MISSING_PLAYBACK_FIELD = "userId and mediaId are required"
QUERY_USER_DEFAULT = "u1"
BODY_SCHEMA = "userId string, mediaId string, plan string, channel string, email string, password string"
# ---- end of fixed values ----


def url_path(path: Column) -> Column:
    """The part before query and fragment."""
    return F.regexp_extract(path, "^([^?#]*)", 1)


def last_segment(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def query_parameter(path: Column, name: str, fallback: str = QUERY_USER_DEFAULT) -> Column:
    """First ``name=value`` item with exactly two parts, else the fallback."""
    query = F.regexp_extract(path, "^[^?#]*\\?([^#]*)", 1)
    # percent escapes are decoded, a plus sign is not
    decoded = F.coalesce(F.try_url_decode(F.replace(query, F.lit("+"), F.lit("%2B"))), query)
    items = F.filter(F.split(decoded, "&"), lambda i: i.rlike(f"^\\Q{name}\\E=[^=]+=*$"))
    return F.coalesce(F.regexp_extract(F.get(items, F.lit(0)), "=([^=]+)", 1), F.lit(fallback))


def route(service: Column, method: Column, path: Column) -> Column:
    """``struct<route, path_id, status, miss_status>`` of one request.

    ``status`` is the code when the request succeeds; ``miss_status`` the
    code when what it names is missing, refused or malformed.
    """
    plain = url_path(path)

    def to(name: str, status: int, miss: int | None = None, path_id: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("route"),
            (F.lit(None).cast("string") if path_id is None else path_id).alias("path_id"),
            F.lit(status).alias("status"),
            F.lit(miss).cast("int").alias("miss_status"),
        )

    unknown = to("unknown", 404)
    unsupported = to("unsupported method", 501)
    get, post = method == "GET", method == "POST"
    movie = F.regexp_extract(plain, "^/movies/([^/]+)$", 1)

    catalog = (
        F.when(get & (plain == "/health"), to("health", 200))
        .when(get & (plain == "/movies"), to("movies", 200))
        .when(get & (movie != ""), to("movie", 200, 404, movie))
        .otherwise(unknown)
    )
    streaming = (
        F.when(get & (plain == "/health"), to("health", 200))
        .when(post & (plain == "/stream/start"), to("stream start", 201, 400))
        .otherwise(unknown)
    )
    auth = (
        F.when(get & (path == "/health"), to("health", 200))
        .when(post & (path == "/login"), to("login", 200, 401))
        .when(get | post, unknown)
        .otherwise(unsupported)
    )
    recommendation = (
        F.when(get & (path == "/health"), to("health", 200))
        .when(get & path.startswith("/recommendations/"), to("recommendations", 200, None, last_segment(path)))
        .when(get, unknown)
        .otherwise(unsupported)
    )

    def per_user_list(name: str) -> Column:
        user = query_parameter(path, "userId")
        here = plain.startswith(f"/{name}")
        return (
            F.when(plain.startswith("/health"), to("health", 200))
            .when(here & get, to(f"{name} list", 200, None, user))
            .when(here & post, to(f"{name} add", 201))
            .when(here, to(f"{name} refused", 405))
            .otherwise(unknown)
        )

    def preference(write: str, read: str) -> Column:
        return (
            F.when(plain == "/health", to("health", 200))
            .when(post & (plain == f"/{write}"), to(write, 201))
            .when(get & plain.startswith(f"/{read}/"), to(read, 200, None, last_segment(plain)))
            .otherwise(unknown)
        )

    return (
        F.when(service == "catalog", catalog)
        .when(service == "streaming", streaming)
        .when(service == "auth", auth)
        .when(service == "recommendation", recommendation)
        .when(service == "watchlist", per_user_list("watchlist"))
        .when(service == "history", per_user_list("history"))
        .when(service == "subscription", preference("subscribe", "subscription"))
        .when(service == "notification", preference("notify", "notifications"))
        .otherwise(unknown)
    )


def playback_session(user: Column, media: Column, ts: Column) -> Column:
    """``struct<session_id, playback_url, error>`` of one playback request."""
    missing = (F.coalesce(user, F.lit("")) == "") | (F.coalesce(media, F.lit("")) == "")
    session = F.concat_ws("-", user, media, F.unix_millis(ts.cast("timestamp")).cast("string"))
    url = F.concat(F.lit(PLAYBACK_URL[0]), media, F.lit(PLAYBACK_URL[1]))
    return F.struct(
        F.when(~missing, session).alias("session_id"),
        F.when(~missing, url).alias("playback_url"),
        F.when(missing, F.lit(MISSING_PLAYBACK_FIELD)).alias("error"),
    )
