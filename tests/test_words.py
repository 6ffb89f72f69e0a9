import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ripplemark.functions import words as W
from ripplemark.operators import terms
from tests.conftest import rows


def brute(text, stop):
    found = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)}
    return {w for w in found if len(w) > 2 and w not in stop}


def test_examples(frame):
    df = frame("path string, content string", ("a", "If the Café 3abc payment_timeout x1 PAYMENT\nfoo _ __ ___"))
    got = {r.term for r in terms.term_rows(df, ["the"]).collect()}
    assert got == {"caf", "abc", "payment_timeout", "payment", "foo", "___"}


def test_letters_with_ascii_lower_forms_end_words(frame):
    # Kelvin sign and dotted capital I lower to ASCII letters
    df = frame("path string, content string", ("a", "abcKdef İstanbul"))
    assert {r.term for r in terms.term_rows(df, []).collect()} == {"abc", "def", "stanbul"}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB_9 .é\n-zK", max_size=40), min_size=1, max_size=6))
def test_terms_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    stop = ["aab", "zzz", "k_9"]
    got = {(r.path, r.term) for r in terms.term_rows(df, stop).collect()}
    assert got == {(str(i), w) for i, t in enumerate(texts) for w in brute(t, stop)}


def test_default_stop_words(frame):
    stop = W.default_stop_words()
    assert len(stop) == len(set(stop)) == 462 and sum(len(w) > 2 for w in stop) == 442
    assert {"token", "session", "endpoint", "user", "catalog", "watchlist", "none", "jsonify", "overridden"} <= set(stop)
    assert not {"filter", "range", "format", "compile", "match", "print", "timeoutms", "cart", "password"} & set(stop)
    got = terms.term_rows(frame("path string, content string", ("a", "Token session filter range cart user ENDPOINT")))
    assert {r.term for r in got.collect()} == {"filter", "range", "cart"}


def test_stop_words_from_a_file(spark, frame, tmp_path):
    (tmp_path / "stop.txt").write_text("Alpha\n beta \n\nalpha\n")
    words = W.read_stop_words(spark, str(tmp_path / "stop.txt"))
    assert {r.word for r in words.collect()} == {"alpha", "beta"}
    files = frame("path string, content string", ("a", "alpha gamma delta"), ("b", "beta"), ("c", "gamma user"))
    assert {tuple(r) for r in terms.term_rows(files, words).collect()} == {("a", "gamma"), ("a", "delta"), ("c", "gamma"), ("c", "user")}
    profiles = {r.path: sorted(r.terms) for r in terms.file_profiles(files, words).collect()}
    assert profiles == {"a": ["delta", "gamma"], "b": [], "c": ["gamma", "user"]}


def test_idf_counts_files_with_text(frame):
    import math

    df = frame(
        "path string, content string",
        ("a", "apple berry"), ("b", "apple apple"), ("c", ""), ("d", "12 34"),
    )
    got = {r.term: (r.df, round(r.idf, 9)) for r in terms.corpus_idf(df, []).collect()}
    # the file without words counts, the empty one does not
    assert got == {"apple": (2, round(math.log(3 / 3), 9)), "berry": (1, round(math.log(3 / 2), 9))}


def test_idf_of_one_file_and_of_none(frame):
    one = frame("path string, content string", ("a", "apple"))
    assert [(r.term, r.idf) for r in terms.corpus_idf(one, []).collect()] == [("apple", 1.0)]
    assert terms.corpus_idf(one.filter("false"), []).count() == 0


def test_sets(frame):
    a, b = frame("term string", "x", "y"), frame("term string", "y", "z")
    assert rows(terms.union_terms(a, b)) == [("x",), ("y",), ("z",)]
    assert rows(terms.common_terms(a, b)) == [("y",)]


def test_change_terms_tokenise_keys_and_both_values(frame):
    changes = frame(
        "key string, old_value string, new_value string",
        ("server.timeout_ms", "30", "sixty seconds"), ("flag", None, "0x1f"),
    )
    got = {r.term for r in terms.change_terms(changes, ["flag"]).collect()}
    assert got == {"server", "timeout_ms", "sixty", "seconds", "none", "x1f"}


def test_extreme_terms_break_ties_by_term(frame):
    idf = frame("term string, df long, idf double", ("b", 1, 2.0), ("a", 1, 2.0), ("c", 5, 0.1))
    got = [(r.side, r.term) for r in terms.extreme_terms(idf, 2).collect()]
    assert sorted(got) == [
        ("most common", "a"), ("most common", "c"), ("most distinctive", "a"), ("most distinctive", "b"),
    ]
