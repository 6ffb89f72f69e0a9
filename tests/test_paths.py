import pytest

from pyspark.sql import functions as F

from ripplemark.functions import paths as P


def evaluate(frame, build, *paths):
    df = frame("path string", *paths).select("path", build("path").alias("v"))
    return {r.path: r.v for r in df.collect()}


def test_names(frame):
    paths = ["a/b.TXT", ".env", "a/.env.local", "noext", "x/archive.tar.gz", "a/trailing.", "..dots"]
    assert evaluate(frame, P.extension, *paths) == {
        "a/b.TXT": "txt", ".env": "", "a/.env.local": "local", "noext": "", "x/archive.tar.gz": "gz",
        "a/trailing.": "", "..dots": "dots",
    }
    assert evaluate(frame, P.stem, *paths) == {
        "a/b.TXT": "b", ".env": ".env", "a/.env.local": ".env", "noext": "noext",
        "x/archive.tar.gz": "archive.tar", "a/trailing.": "trailing.", "..dots": ".",
    }
    assert evaluate(frame, P.directory, "a/b/c.py", "c.py") == {"a/b/c.py": "a/b", "c.py": ""}


def test_service_name_examples(frame):
    expected = {
        "platform_services/auth-service/src/app.py": "auth",
        "platform_services/notification-service/Service.cs": "notification",
        "rideshare_services/config/driver_config.py": "driver",
        "rideshare_services/driver_service.py": "driver",
        "tests/test_driver_service.py": "driver",
        "ecommerce_services/config/cart.config.js": "cart",
        "src/paymentservice/index.js": "paymentservice",
    }
    assert evaluate(frame, P.service_name, *expected) == expected


def test_service_name_fallbacks(frame):
    expected = {
        "orders-api/src/main.go": "orders",     # generic name, nearest named directory
        "src/app.py": "app",                     # only plain directories: the name itself
        "app.py": "app",
        "x/service.py": "x",                     # the whole name is a suffix
        "a_service/b-service/c/d.py": "b",       # innermost service directory
        "lib/order_controller.rb": "order",
        "lib/user_service_tests.py": "user",     # longest suffix, stripped once
        "pkg/__init__.py": "init",              # underscores go first, so the name is not generic
    }
    assert evaluate(frame, P.service_name, *expected) == expected


@pytest.mark.parametrize(
    "path, is_config",
    [
        ("config/auth_config.py", True), ("src/Config/db.py", True), ("src/config.py", True),
        ("package.json", True), ("x/Dockerfile", True), ("web/order.config.js", True), ("x.envelope.py", True),
        ("a/app.settings", True), ("a/data.toml", True), ("config_parser.py", True), ("settings", True),
        ("order_service.js", False), ("data.json", False), ("myconfig/x.py", False), ("README.md", False),
    ],
)
def test_config_rules(frame, path, is_config):
    assert evaluate(frame, P.is_config_file, path) == {path: is_config}


def test_test_names(frame):
    yes = [
        "test_order.py", "order_test.py", "OrderTest.java", "OrderTests.java", "order.test.js", "order.spec.js",
        "order_test.go", "order_spec.rb", "OrderTests.cs", "order.spec.ts", "latest.js", "inspector.py",
    ]
    no = ["order.py", "test_notes.md", "tests/order.py"]
    found = evaluate(frame, P.is_test_file, *yes, *no)
    assert found == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}


def test_category_prefers_config(frame):
    found = evaluate(frame, P.category, "payment.config.js", "order_service.js", "LICENSE")
    assert found == {"payment.config.js": "config", "order_service.js": "source", "LICENSE": None}


def test_exclusions(frame):
    found = evaluate(frame, P.is_artifact, "a/analyzer_result.json", "x/y.pyc", "dist/a.js", "a/b.py", "redist/a.js")
    assert [found[p] for p in ("a/analyzer_result.json", "x/y.pyc", "dist/a.js", "a/b.py", "redist/a.js")] == [
        True, True, True, False, False,
    ]
    skipped = evaluate(frame, P.is_skipped_by_scan, "a/target/x.java", "a/targets/x.java", ".git/x", "bin")
    assert skipped == {"a/target/x.java": True, "a/targets/x.java": False, ".git/x": True, "bin": True}


def test_expressions_stay_in_codegen(frame):
    df = frame("path string", "a/b.py").select(P.category("path"), P.is_test_file("path"), P.is_artifact("path"))
    assert "Project" in df._jdf.queryExecution().executedPlan().toString()
    assert df.filter(F.lit(True)).count() == 1
