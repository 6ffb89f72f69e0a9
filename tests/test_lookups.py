import hashlib

from ripplemark.operators import lookups
from tests.conftest import rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_login(frame):
    users = frame("email string, password_digest string, user_id string", ("demo@example.com", digest("demo123"), "u1"))
    attempts = frame(
        "seq long, email string, password_digest string",
        (1, "demo@example.com", digest("demo123")), (2, "demo@example.com", digest("wrong")),
        (3, "nobody@example.com", digest("demo123")), (4, None, None),
    )
    got = rows(lookups.login_audit(attempts, users), "seq", "token", "status")
    assert got == [(1, "token-u1", 200), (2, None, 401), (3, None, 401), (4, None, 401)]


def test_recommendations(frame):
    recs = frame(
        "user_id string, pos long, media_id string", ("u1", 0, "m2"), ("u1", 1, "m3"), ("u2", 0, "m1"), ("u2", 1, "m3")
    )
    got = rows(lookups.recommendations(recs, frame("user_id string", "u1", "nobody", "u1")))
    assert got == [("nobody", 0, "m1"), ("nobody", 1, "m2"), ("u1", 0, "m2"), ("u1", 1, "m3")]


def test_movies(frame):
    movies = frame(
        "id string, title string, genre string, year int",
        ("m1", "First Film", "Drama", 2026), ("m2", "Second Film", "Thriller", 2025),
    )
    got = lookups.movie_lookup(frame("id string", "m1", "missing"), movies)
    assert rows(got, "id", "title", "status") == [("m1", "First Film", 200), ("missing", None, 404)]
    assert lookups.catalogue(movies).count() == 2


def test_notified(frame):
    got = lookups.has_been_notified(frame("user_id string", "a", "b"), frame("user_id string", "a", "a"))
    assert rows(got) == [("a", True), ("b", False)]


def test_failing_services(frame):
    probes = frame("service string, status int", ("a", 200), ("a", 500), ("b", 500))
    got = lookups.failing_services(frame("service string", "a", "b", "c"), probes)
    assert rows(got) == [("b",), ("c",)]
