import pytest
from datetime import datetime

from pyspark.sql import functions as F

from ripplemark.functions import http
from ripplemark.sources.bodies import read_bodies
from tests.conftest import rows


def test_routes(frame):
    table = [
        ("catalog", "GET", "/health?x=1", ("health", None, 200, None)),
        ("catalog", "POST", "/health", ("unknown", None, 404, None)),
        ("catalog", "GET", "/movies", ("movies", None, 200, None)),
        ("catalog", "GET", "/movies/m1?x", ("movie", "m1", 200, 404)),
        ("catalog", "GET", "/movies/m1/x", ("unknown", None, 404, None)),
        ("streaming", "POST", "/stream/start", ("stream start", None, 201, 400)),
        ("streaming", "GET", "/stream/start", ("unknown", None, 404, None)),
        ("auth", "GET", "/health?x", ("unknown", None, 404, None)),
        ("auth", "POST", "/login", ("login", None, 200, 401)),
        ("auth", "PUT", "/login", ("unsupported method", None, 501, None)),
        ("recommendation", "GET", "/recommendations/a/u1", ("recommendations", "u1", 200, None)),
        ("recommendation", "POST", "/recommendations/u1", ("unsupported method", None, 501, None)),
        ("watchlist", "DELETE", "/health", ("health", None, 200, None)),
        ("watchlist", "GET", "/watchlist?userId=u7", ("watchlist list", "u7", 200, None)),
        ("watchlist", "GET", "/watchlist", ("watchlist list", "u1", 200, None)),
        ("history", "POST", "/history", ("history add", None, 201, None)),
        ("history", "DELETE", "/history", ("history refused", None, 405, None)),
        ("history", "GET", "/watchlist", ("unknown", None, 404, None)),
        ("subscription", "PUT", "/health", ("health", None, 200, None)),
        ("subscription", "POST", "/subscribe", ("subscribe", None, 201, None)),
        ("subscription", "GET", "/subscription/u1", ("subscription", "u1", 200, None)),
        ("notification", "POST", "/notify", ("notify", None, 201, None)),
        ("notification", "GET", "/notifications/x/u2", ("notifications", "u2", 200, None)),
        ("other", "GET", "/health", ("unknown", None, 404, None)),
    ]
    df = frame("i int, service string, method string, path string", *[(i, *t[:3]) for i, t in enumerate(table)])
    got = df.select("i", http.route(F.col("service"), F.col("method"), F.col("path")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [t[3] for t in table]


@pytest.mark.parametrize(
    "path, value",
    [
        ("/w?userId=u7", "u7"), ("/w?a=1&userId=u7&userId=u8", "u7"), ("/w", "u1"), ("/w?userId=", "u1"),
        ("/w?userId=a=b", "u1"), ("/w?userId=a=", "a"), ("/w?xuserId=a", "u1"), ("/w?userId=a%20b+c", "a b+c"),
    ],
)
def test_query_parameter(frame, path, value):
    df = frame("p string", path).select(http.query_parameter(F.col("p"), "userId").alias("v"))
    assert df.first().v == value


def test_playback(frame):
    ts = datetime(2024, 1, 1, 0, 0, 1, 500900)
    df = frame("u string, m string, ts timestamp", ("u1", "m1", ts), ("", "m1", ts), ("u1", None, ts))
    got = [r.s for r in df.select(http.playback_session(F.col("u"), F.col("m"), F.col("ts")).alias("s")).collect()]
    assert got[0].session_id == "u1-m1-1704067201500"
    assert got[0].playback_url == "http://localhost:8102/media/m1/manifest.m3u8"
    assert [g.error for g in got] == [None, "userId and mediaId are required", "userId and mediaId are required"]


def test_bodies(frame):
    df = frame(
        "seq int, body string",
        (1, '{"userId": "u1", "plan": "Premium"}'), (2, '{"userId":"u1"}'), (3, ""), (4, "{bad"), (5, "[1]"), (6, None), (7, " "),
    )
    got = rows(read_bodies(df, {"userId": "", "plan": "basic"}), "seq", "rejected", "userId", "plan")
    assert got == [
        (1, False, "u1", "Premium"), (2, False, "u1", "basic"), (3, False, "", "basic"),
        (4, True, None, None), (5, True, None, None), (6, False, "", "basic"), (7, True, None, None),
    ]
