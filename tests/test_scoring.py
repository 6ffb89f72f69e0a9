import random
import re
from pathlib import PurePosixPath

import pytest

from ripplemark.operators import scoring, terms
from tests.conftest import rows

FILES = "path string, content string"


def relevance(frame, tests, services):
    df = scoring.service_relevance(frame(FILES, *tests), frame("service string", *services))
    return {r.path: r.service_score for r in df.collect()}


@pytest.mark.parametrize(
    "path, content, service, score",
    [
        ("tests/test_auth.py", "", "auth", 1.0),
        ("tests/user-auth.spec.js", "", "auth", 1.0),
        ("tests/test_authx.py", "", "auth", 0.0),
        ("tests/test_user_auth_flow.py", "", "user_auth", 1.0),
        ("auth-service/t.py", "", "auth", 0.95),
        ("a/auth_service/t.py", "", "auth", 0.95),
        ("media_auth_services/t.py", "", "auth", 0.0),
        ("auth/auth-service/t.py", "", "auth", 0.9),   # the first segment wins
        ("auth-service/auth/t.py", "", "auth", 0.95),
        ("t/test_payment.py", "", "paymentservice", 0.7),
        ("t/test_cart.py", "", "cartservice", 0.0),     # root word too short
        ("t/a.py", "IMPORT auth\n", "auth", 0.4),
        ("t/a.py", "from  auth.models import x", "auth", 0.4),
        ("t/a.py", "from import auth", "auth", 0.4),    # keywords may overlap
        ("t/a.py", "import auth2", "auth", 0.0),
        ("t/a.py", "reimport auth", "auth", 0.0),
        ("t/a.py", "éimport auth", "auth", 0.0),        # any letter continues a word
        ("t/a.py", "import authé", "auth", 0.0),
        ("t/a.py", "GET /auth-service/x", "auth", 0.3),
        ("t/a.py", "GET /auth/auth", "auth", 0.3),
        ("t/a.py", "GET /auth", "auth", 0.0),
        ("t/a.py", "about auth", "auth", 0.0),
        ("t/a.py", "import my app;", "my app", 0.4),
        ("t/a.py", "x/a.b/y", "a.b", 0.3),
        ("t/a.py", "x/aXb/y", "a.b", 0.0),
    ],
)
def test_rules(frame, path, content, service, score):
    assert relevance(frame, [(path, content)], [service]) == {path: score}


def test_best_service_wins(frame):
    got = relevance(frame, [("auth/test_user.py", "import cart")], ["auth", "cart", "zzz"])
    assert got == {"auth/test_user.py": 0.9}


def test_no_services(frame):
    df = scoring.service_relevance(frame(FILES, ("a/test_x.py", "import x")), frame("service string", "x").filter("false"))
    assert rows(df) == [("a/test_x.py", 0.0)]


def brute_relevance(path, content, service):
    stem, s, text = PurePosixPath(path).stem.lower(), service.lower(), content.lower()
    root = s.replace("service", "").strip("-_")
    edge = r"(?:^|[_\-.]){}(?:$|[_\-.])"
    if re.search(edge.format(re.escape(s)), stem):
        return 1.0
    for part in [p for p in path.lower().split("/") if p]:
        if part in (s + "-service", s + "_service"):
            return 0.95
        if part == s:
            return 0.9
    if len(root) >= 5 and re.search(edge.format(re.escape(root)), stem):
        return 0.7
    if re.search(rf"\b(?:import|from)\s+{re.escape(s)}\b", text):
        return 0.4
    return 0.3 if re.search(rf"/{re.escape(s)}(?:-service)?/", text) else 0.0


def test_relevance_equals_brute_force(frame):
    rng = random.Random(7)
    words = ["auth", "auth-service", "user", "user_auth", "payments", "paymentsservice", "a.b", "x", "test", "-", "_", "é"]
    gaps = [" ", "\n", "/", ".", "-", ""]

    def content():
        out = ""
        for _ in range(rng.randint(0, 12)):
            out += rng.choice(["import", "from", "/", "", *words]) + rng.choice(gaps)
        return out

    tests = {}
    for _ in range(150):
        parts = [rng.choice(words[:9]) for _ in range(rng.randint(0, 3))]
        name = rng.choice(["", "test_"]) + rng.choice(["_", "-", "."]).join(rng.choices(words[:9], k=rng.randint(1, 3)))
        tests["/".join([*parts, name + ".py"])] = content()
    services = ["auth", "user_auth", "paymentsservice", "a.b", "Auth-Service", "x"]
    want = {p: max(brute_relevance(p, c, s) for s in services) for p, c in tests.items()}
    assert relevance(frame, list(tests.items()), services) == want
    assert len(set(want.values())) >= 5


def lexical(frame, changed, tests, idf=None):
    files = frame(FILES, *tests)
    weights = None if idf is None else frame("term string, idf double", *idf)
    chosen = terms.distinctive_terms(frame("term string", *changed), weights)
    return {
        r.path: round(r.lexical, 6)
        for r in scoring.lexical_scores(terms.term_rows(files, []), files, chosen).collect()
    }


TESTS = [("t1", "alpha beta"), ("t2", "gamma"), ("t3", "")]


def test_lexical_counts_distinctive_terms(frame):
    idf = [("alpha", 2.0), ("beta", 1.5), ("gamma", 3.0)]
    assert lexical(frame, ["alpha", "beta", "gamma", "delta"], TESTS, idf) == {"t1": 0.5, "t2": 0.5, "t3": 0.0}


def test_lexical_falls_back_to_all_terms(frame):
    assert lexical(frame, ["alpha", "delta"], TESTS, [("alpha", 0.5)]) == {"t1": 0.5, "t2": 0.0, "t3": 0.0}
    assert lexical(frame, ["alpha", "delta"], TESTS) == {"t1": 0.5, "t2": 0.0, "t3": 0.0}


def test_lexical_without_changed_terms_is_zero(frame):
    files = frame(FILES, *TESTS)
    none = frame("term string", "x").filter("false")
    for idf in (None, frame("term string, idf double", ("alpha", 2.0))):
        scores = scoring.lexical_scores(terms.term_rows(files, []), files, terms.distinctive_terms(none, idf))
        assert {r.lexical for r in scores.collect()} == {0.0}


def test_lexical_ranking(frame):
    scores = frame("path string, lexical double", ("c", 0.2), ("a", 0.8), ("b", 0.2), ("z", 0.05))
    assert [r.path for r in scoring.rank_lexical(scores).collect()] == ["a", "b", "c"]


def test_combined_ranking(frame):
    lex = frame("path string, lexical double", ("a", 1.0), ("b", 0.2), ("c", 0.19), ("d", 1.0), ("e", 0.0))
    rel = frame("path string, service_score double", ("a", 0.4), ("b", 0.7), ("c", 0.7), ("d", 0.3), ("e", 0.9))
    ranked = scoring.best_first(scoring.combined_ranking(lex, rel))
    # b reaches 0.3 * 0.2 + 0.7 * 0.7 = 0.5499999999999999 only
    assert [(r.path, r.score) for r in ranked.collect()] == [("e", 0.63), ("a", 0.58)]
    # dropping tests that cannot rank changes nothing
    for threshold in (0.55, 0.3, 0.05):
        whole = scoring.best_first(scoring.combined_ranking(lex, rel, threshold))
        again = scoring.combined_ranking(lex, scoring.worth_scoring(rel, threshold), threshold)
        assert scoring.best_first(again).collect() == whole.collect()
    assert whole.count() == 5


def reduced(path):
    name = PurePosixPath(path).stem.lower()
    for part in ["_service", "service", "_test", "test", "_spec", "spec"]:
        name = name.replace(part, "")
    return name


def test_filename_bonus_equals_brute_force(frame):
    rng = random.Random(3)
    names = ["auth", "user", "pay", "test", "spec", "x", "service", "authority"]
    changed = [f"src/{'_'.join(rng.choices(names, k=rng.randint(1, 2)))}.py" for _ in range(6)] + ["test.py"]
    tests = sorted({f"t/test_{''.join(rng.choices(names, k=rng.randint(1, 3)))}.py" for _ in range(60)})
    df = scoring.filename_bonus(frame("path string", *changed), frame("path string", *tests))
    want = {t: 0.3 if any(reduced(c) and reduced(c) in reduced(t) for c in changed) else 0.0 for t in tests}
    assert {r.path: r.bonus for r in df.collect()} == want
    assert set(want.values()) == {0.0, 0.3}
