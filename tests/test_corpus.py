import json
import random
from collections import Counter

import pytest

from ripplemark.plans.impact import analyze
from ripplemark.sources import corpus, reports
from tests.conftest import rows

FILES = "path string, content string"


def test_scan_reads_text_and_drops_bad_bytes(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src" / "deep").mkdir(parents=True)
    (root / "src" / "deep" / "a.py").write_text("héllo", encoding="utf-8")
    (root / "b.bin").write_bytes(b"\xff\xfe\x00")
    (root / "empty.py").write_text("")
    got = {r.path: r.content for r in corpus.scan_files(spark, str(root)).collect()}
    assert got == {"src/deep/a.py": "héllo", "b.bin": ""}  # the scan skips empty files
    listing = spark.createDataFrame([("src/deep/a.py",), ("empty.py",), ("gone.py",)], "path string")
    got = {r.path: r.content for r in corpus.scan_files(spark, str(root), listing=listing).collect()}
    assert got == {"src/deep/a.py": "héllo", "b.bin": "", "empty.py": "", "gone.py": ""}
    assert [r.path for r in corpus.scan_files(spark, str(root), glob="*.py").collect()] == ["src/deep/a.py"]


def test_scan_reads_no_skipped_folder(spark, tmp_path):
    root = tmp_path / "my target"
    for path in ["src/a b.py", "node_modules/x/i.js", "x/target/T.java", "src/c+d.py"]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(path)
    found = corpus.corpus_files(corpus.scan_files(spark, str(root), skip=True))
    assert {r.path: r.content for r in found.collect()} == {"src/a b.py": "src/a b.py", "src/c+d.py": "src/c+d.py"}
    scan = corpus.scan_files(spark, str(root), skip=True)._jdf.queryExecution().executedPlan()
    assert "file_path" in scan.toString()


def test_bucketed_revisions_join_without_a_shuffle(spark, frame):
    old = corpus.save_bucketed(frame(FILES, *OLD), "bucketed_old", 4)
    new = corpus.save_bucketed(frame(FILES, *changed_repo()), "bucketed_new", 4)
    try:
        changes = corpus.changed_files(old, new)
        assert changes.count() == 3
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = corpus.changed_files(old, new)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_old")
        spark.sql("drop table bucketed_new")


def test_corpus_and_tests(frame):
    files = frame(FILES, ("a/x.py", ""), ("a/x.md", ""), ("dist/x.py", ""), ("t/test_x.py", ""))
    assert rows(corpus.corpus_files(files), "path") == [("a/x.py",), ("t/test_x.py",)]
    assert rows(corpus.find_tests(files), "path") == [("t/test_x.py",)]
    outside = frame(FILES, ("t/test_x.py", "other"), ("more/test_y.py", ""))
    whole = corpus.with_tests(corpus.corpus_files(files), outside)
    assert rows(whole) == [("a/x.py", ""), ("more/test_y.py", ""), ("t/test_x.py", "")]


def test_change_set(frame):
    old = frame(FILES, ("same", "1"), ("edited", "1"), ("deleted", "1"))
    new = frame(FILES, ("same", "1"), ("edited", "2"), ("added", "1"))
    assert rows(corpus.changed_files(old, new)) == [("added", "added"), ("edited", "modified")]


def test_reviewable(frame):
    changes = frame("path string, change_kind string", ("a.pyc", "added"), ("a.py", "added"), ("x.conf", "added"), ("README", "added"))
    assert rows(corpus.reviewable(changes), "path", "category") == [("README", None), ("a.py", "source"), ("x.conf", "config")]


def test_changed_lines(frame):
    old = frame(FILES, ("f", "a\nb\nb\n-- c\n"), ("g", "x"), ("same", "q"), ("moved", "a\nname: cartservice\nb\nc\n"))
    new = frame(FILES, ("f", "b\na\nd\nd"), ("g", "x\n"), ("h", "new"), ("moved", "a\nb\nc\nname: cartservice\n"))
    changes = corpus.changed_files(old, new)
    got = rows(corpus.changed_lines(old, new, changes))
    assert [r for r in got if r[0] == "g"] == [("g", "+", "x", 1), ("g", "-", "x", 1)]  # its line feed is new
    assert [r for r in got if r[0] == "h"] == [("h", "+", "new", 1)]
    assert [r for r in got if r[0] == "moved"] == [("moved", "+", "name: cartservice", 1), ("moved", "-", "name: cartservice", 1)]
    net = {}
    for _, side, line, n in (r for r in got if r[0] == "f"):
        net[line] = net.get(line, 0) + (n if side == "+" else -n)
    assert {line: n for line, n in net.items() if n} == {"d": 2, "-- c": -1, "b": -1}
    blank = corpus.changed_lines(
        frame(FILES, ("f", "a\n\n")), frame(FILES, ("f", "a\n")), frame("path string", "f")
    )
    assert rows(blank) == [("f", "-", "", 1)]
    empty = corpus.changed_lines(frame(FILES, ("f", None)), frame(FILES, ("f", "")), frame("path string", "f"))
    assert rows(empty) == []


OLD = [
    ("services/cart-service/src/app.py", "def total(): return basket_sum"),
    ("services/cart-service/tests/test_app.py", "from cart import total\nassert basket_sum checkout_total"),
    ("services/user-service/tests/test_user.py", "user profile"),
    ("services/user-service/src/user.py", "profile picture"),
    ("services/user-service/src/more.py", "avatar thumbnail"),
    ("config/cart.properties", "port=1\n"),
    ("docs/README.md", "text"),
]


def changed_repo():
    new = dict(OLD)
    new["services/cart-service/src/app.py"] += "\ncheckout_total = 1"
    new["config/cart.properties"] = "port=2\nname: emailservice\n"
    new["docs/README.md"] = "other"
    return list(new.items())


def test_impact_from_files_to_report(spark, frame, tmp_path):
    run = analyze(frame(FILES, *OLD), frame(FILES, *changed_repo()), stop_words=["def", "return", "from", "port"])
    assert rows(run.changes, "path", "category") == [
        ("config/cart.properties", "config"), ("docs/README.md", None), ("services/cart-service/src/app.py", "source"),
    ]
    assert rows(run.services) == [("cart",), ("emailservice",)]
    assert rows(run.changed_terms) == [("basket_sum",), ("checkout_total",), ("name",), ("total",)]
    ranked = run.ranked.collect()
    assert [r.path for r in ranked] == ["services/cart-service/tests/test_app.py"]
    # 3 of 4 changed terms, all below the idf threshold, in a service directory
    assert (ranked[0].lexical, ranked[0].service_score, ranked[0].score) == (0.75, 0.95, 0.89)

    reports.write_report(run.entries(), run.summary(), str(tmp_path / "report"))
    back = rows(reports.read_report(spark, str(tmp_path / "report")), "section", "path")
    assert back == [
        ("affected_tests", "services/cart-service/tests/test_app.py"),
        ("changed_files", "config/cart.properties"), ("changed_files", "docs/README.md"),
        ("changed_files", "services/cart-service/src/app.py"),
        ("config_files", "config/cart.properties"), ("source_files", "services/cart-service/src/app.py"),
    ]
    summary = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert (summary.has_affected_tests, summary.test_count, summary.total_tests_analyzed) == (True, 1, 2)
    assert (summary.n_changed_files, summary.n_source_files, summary.n_config_files) == (3, 1, 1)

    reports.write_document(run.entries(), run.summary(), str(tmp_path / "document"))
    parts = sorted((tmp_path / "document").glob("part-*"))
    (tmp_path / "whole.json").write_text("".join(p.read_text() for p in parts))
    document = reports.read_documents(spark, str(tmp_path / "whole.json")).first()
    assert document.affected_tests == ["services/cart-service/tests/test_app.py"]
    assert document.summary.changed_files == ["config/cart.properties", "docs/README.md", "services/cart-service/src/app.py"]
    assert (document.test_count, document.summary.total_tests_analyzed) == (1, 2)


def test_a_long_document(spark, frame, tmp_path):
    entries = [("affected_tests", f't"{i}', float(i % 7)) for i in range(500)] + [("changed_files", f"c\\{i:03}", None) for i in range(300)]
    entries = frame(reports.ENTRY_SCHEMA, *entries)
    summary = reports.report_summary(entries, frame("path string", "a", "b"))
    reports.write_document(entries, summary, str(tmp_path / "document"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "document").glob("part-*")))
    found = json.loads(text)
    assert found["affected_tests"] == sorted((f't"{i}' for i in range(500)), key=lambda t: (-(int(t[2:]) % 7), t))
    assert found["summary"]["changed_files"] == [f"c\\{i:03}" for i in range(300)]
    assert (found["test_count"], found["summary"]["config_files"], found["summary"]["total_tests_analyzed"]) == (500, [], 2)


def test_impact_without_changes(frame):
    files = frame(FILES, *OLD)
    run = analyze(files, files)
    assert run.ranked.count() == 0 and run.summary().first().has_affected_tests is False


def test_impact_with_terms_missing(frame):
    # a changed config file without a reader has no terms: lexical 0, not an error
    old = frame(FILES, ("config/auth_config.py", "A=1"), ("auth-service/tests/test_login.py", "login works"))
    new = frame(FILES, ("config/auth_config.py", "A=2"), ("auth-service/tests/test_login.py", "login works"))
    ranked = analyze(old, new).ranked.collect()
    assert [(r.lexical, r.score) for r in ranked] == [(0.0, 0.665)]


def test_result_documents_have_defaults(spark, tmp_path):
    (tmp_path / "d1.json").write_text('{"affected_tests":[],"has_affected_tests":false,"test_count":0}')
    (tmp_path / "d2.json").write_text(
        json.dumps(
            {
                "affected_tests": ["t"], "has_affected_tests": True, "test_count": 1,
                "summary": {"changed_files": ["a", "b"], "source_files": ["a"], "total_tests_analyzed": 9},
            },
            indent=2,
        )
    )
    (tmp_path / "d3.json").write_text("{}")
    got = rows(reports.summarize_documents(reports.read_documents(spark, str(tmp_path))))
    assert got == [(False, 0, 0, 0, 0, 0, 0), (False, 0, 0, 0, 0, 0, 0), (True, 1, 2, 1, 0, 9, 1)]


def test_renames_in_three_steps(spark, frame):
    """Equal contents in path order, then namesakes, then each other's most similar; what is left was added."""
    text = "".join(f"line {i} of the file\n" for i in range(20))
    other = "".join(f"entry {i} of another\n" for i in range(20))
    old = frame(
        FILES, ("a/x.py", "same"), ("b/x.py", "same"), ("c/x.py", "same"), ("lib/tool.py", text), ("lib/core.py", other),
        ("kept.py", "1"), ("gone.py", "nothing like it"),
    )
    new = frame(
        FILES, ("m/1.py", "same"), ("m/2.py", "same"), ("src/tool.py", "new head\n" + text), ("src/kernel.py", other + "new tail\n"),
        ("src/nucleus.py", other + "a much longer new tail than the other one has\n"), ("kept.py", "2"), ("fresh.py", "quite new"),
    )
    assert rows(corpus.change_set(old, new)) == [
        ("fresh.py", "added", None), ("kept.py", "modified", None), ("m/1.py", "renamed", "a/x.py"), ("m/2.py", "renamed", "b/x.py"),
        ("src/kernel.py", "renamed", "lib/core.py"), ("src/nucleus.py", "added", None), ("src/tool.py", "renamed", "lib/tool.py"),
    ]
    assert rows(corpus.change_set(old, old)) == []


def test_similar_renames_equal_brute_force(spark, frame):
    """No pair that shares half of the longer file is lost by the leading lines."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["", "}"]

    def text():
        return "\n".join(draw.choices(words, weights=[1] * 12 + [9, 9], k=draw.randint(1, 9)))

    old, new = {f"o{i:02}": text() for i in range(40)}, {f"n{i:02}": text() for i in range(40)}
    found = dict((r.path, r.old_path) for r in corpus.change_set(frame(FILES, *old.items()), frame(FILES, *new.items())).collect())

    pool_old, want = dict(old), dict.fromkeys(new)
    for path in sorted(new):
        same = sorted(p for p in pool_old if pool_old[p] == new[path])
        if same:
            want[path] = same[0]
            del pool_old[same[0]]

    def share(a, b):
        both = Counter(a.split("\n")) & Counter(b.split("\n"))
        return sum(n * (len(line) + 1) for line, n in both.items()) / (max(len(a), len(b)) + 1)

    open_new = [p for p in new if want[p] is None]
    near = {(p, q): share(new[p], pool_old[q]) for p in open_new for q in pool_old}
    near = {pair: s for pair, s in near.items() if s >= corpus.SIMILAR}
    best = {p: min((-s, q) for (x, q), s in near.items() if x == p)[1] for p in {x for x, _ in near}}
    best_old = {q: min((-s, p) for (p, y), s in near.items() if y == q)[1] for q in {y for _, y in near}}
    want.update({p: q for p, q in best.items() if best_old[q] == p})
    assert found == want and sum(v is not None for v in want.values()) > 10
