from ripplemark.operators import selection
from tests.conftest import rows

ACCESS = [
    ("TestCheckout", "server.timeout"), ("TestCheckout", "inventory.retry.attempts"),
    ("TestCheckout", "server.timeout"), ("TestInventory", "inventory.retry.attempts"),
]


def test_dependencies(frame):
    edges = selection.dependency_edges(frame("test_id string, config_key string", *ACCESS))
    assert edges.count() == 3
    assert rows(selection.dependency_sizes(edges)) == [("TestCheckout", 2), ("TestInventory", 1)]
    assert rows(selection.dependency_totals(edges)) == [(2, 3)]
    assert rows(selection.dependency_totals(edges.filter("false"))) == [(0, 0)]
    asked = selection.dependencies_of(edges, frame("test_id string", "TestInventory", "TestNew"))
    assert rows(asked, "test_id", "config_key") == [("TestInventory", "inventory.retry.attempts"), ("TestNew", None)]


def test_selection_by_changed_key(frame):
    edges = selection.dependency_edges(frame("test_id string, config_key string", *ACCESS))
    changed = frame("config_key string", "inventory.retry.attempts", "inventory.retry.attempts", "unused")
    assert rows(selection.select_by_config(edges, changed)) == [
        ("TestCheckout", "inventory.retry.attempts"), ("TestInventory", "inventory.retry.attempts"),
    ]


def test_runners(frame):
    tests = frame("path string", "a.py", "b.js", "c.ts", "d.java", "e.kt", "f.cpp", "g.swift", "h")
    got = {r.path: r.runner for r in selection.group_by_runner(tests).collect()}
    assert got == {
        "a.py": "pytest", "b.js": "npm (jest/mocha)", "c.ts": "npm", "d.java": "maven", "e.kt": "maven",
        "f.cpp": "ctest", "g.swift": "unknown (swift)", "h": "unknown ()",
    }
    own = selection.group_by_runner(tests, {"swift": "xctest"}).filter("path = 'g.swift'").first()
    assert own.runner == "xctest"


def test_extension_groups(frame):
    tests = frame("path string", "a.py", "b.js", "c.TS", "d.java", "e.cs", "f.go")
    assert rows(selection.group_by_extension(tests)) == [
        ("cs", "e.cs"), ("java", "d.java"), ("js", "b.js"), ("js", "c.TS"), ("py", "a.py"),
    ]


def test_nearest_root(frame):
    files = frame(
        "path string", "package.json", "a/pom.xml", "a/b/c/setup.py", "svc/app.csproj", "svc/tests/x.sln",
        "1/requirements.txt",
    )
    tests = frame(
        "path string", "a/b/c/d/test_x.py", "a/b/XTest.java", "a/b/x.test.js", "z/test_y.py", "svc/tests/T.cs",
        "svc/more/T.cs", "test_root.js", "q/test.go", "1/2/3/4/5/6/test_near.py", "1/2/3/4/5/6/7/test_far.py",
    )
    got = {r.path: r.root for r in selection.project_roots(tests, files).collect()}
    assert got == {
        "a/b/c/d/test_x.py": "a/b/c", "a/b/XTest.java": "a", "a/b/x.test.js": "", "z/test_y.py": "z",
        "svc/tests/T.cs": "svc/tests", "svc/more/T.cs": "svc", "test_root.js": "", "q/test.go": "q",
        "1/2/3/4/5/6/test_near.py": "1", "1/2/3/4/5/6/7/test_far.py": "1/2/3/4/5/6/7",
    }
    grouped = selection.group_by_root(selection.project_roots(tests, files))
    assert ("a/b/c", "d/test_x.py") in rows(grouped) and ("", "a/b/x.test.js") in rows(grouped)


def test_languages_in_marker_order(frame):
    files = frame(
        "path string", "setup.py", "package.json", "requirements.txt", "x/Foo.csproj", "x/Bar.csproj", "x/all.sln",
        "x/pom.xml", "y/readme.md", "y/cargo.toml",
    )
    got = {r.root: r.languages for r in selection.detect_languages(files).collect()}
    assert got == {
        "": ["JavaScript / Node.js", "Python (pip)", "Python (legacy)"],
        "x": ["Java (Maven)", "C# (.NET)", "C# / .NET Solution"],
    }
