"""Languages, main texts, leaks and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from ripplemark.llm import decontamination, html_extract, language_id
from ripplemark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, suffix string, posterior double, row int"
STOCK = {
    "en": "the and that with from this was were have which their there would people time house water under night".split(),
    "de": "der und nicht eine wird sich auch nach über zwischen haben werden können Straße Häuser möglich schön".split(),
    "fr": "les des une que pour dans avec être était où très français élève garçon ils nous vous après même".split(),
}


def sentence(r, lang, n=25):
    return " ".join(r.choice(STOCK[lang]) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "h", "x", 0.5, 1) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    return [(i, sentence(r, lang := r.choice(list(STOCK))), lang, f"{lang}.example.{'org' if i % 2 else lang}") for i in range(240)]


def test_held_out_languages(spark, corpus):
    model = language_id.fit(docs_of(spark, corpus[:120]))
    assert model[0] == ["de", "en", "fr"]
    rest = docs_of(spark, [(i, t, None, None) for i, t, _, _ in corpus[120:]])
    done = language_id.identify(language_id.document_rows(rest, rest.doc_id), model)
    got = {r.doc_id: r.language for r in done.collect()}
    right = sum(got[i] == lang for i, _, lang, _ in corpus[120:])
    assert right >= 118


def test_evidence_beside_the_text(spark, corpus):
    """A text that says nothing follows its host; a host that is unknown its suffix; a wrong declaration gives way to the text."""
    odd = [
        (900, "42 zzz", None, "fr.example.fr"), (901, "42 zzz", None, "new.example.de"), (902, sentence(random.Random(1), "en"), "de", "fr.example.fr"),
        (903, None, "en", "en.example.org"), (904, "", None, None), (905, "123 ... !!", "de", "de.example.de"), (906, "ТЕКСТ на другом языке " * 20, None, "en.example.org"),
        (907, sentence(random.Random(2), "fr", 60000), None, None),
    ]
    docs = docs_of(spark, corpus + odd + [corpus[0]])
    got = {r.doc_id: r for r in language_id.identify_documents(docs).collect()}
    assert got[900].language == "fr" and got[901].language == "de" and got[902].language == "en" and got[907].language == "fr"
    assert [got[i].accepted for i in (903, 904, 905)] == [False] * 3 and got[904].language == "und"
    assert got[906].language == "und" and not got[906].accepted
    kept = language_id.accepted_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(corpus) + 1 + 4 and not {903, 904, 905, 906} & set(ids)
    assert language_id.identify_documents(docs_of(spark, [])).count() == 0


def test_pages(spark, corpus):
    pages = [(1, "https://fr.example.fr/a?x=1", f"<html lang='fr-FR'><script>var the = 'and that';</script><p>{sentence(random.Random(4), 'fr')}"), (2, None, None), (3, "x", "")]
    docs = docs_of(spark, corpus)
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got[1].language == "fr" and got[2].language == got[3].language == "und"


def test_trigrams():
    assert (language_id.grams("ÄÖ Été".encode()) == language_id.grams("äö été".encode())).all()
    assert (language_id.grams(b"A,b!  c") == language_id.grams(b"a b c")).all()
    assert len(language_id.grams(b"")) == len(language_id.grams(b"12 ?")) == 0
    assert language_id.grams("日本語".encode()).max() < language_id.BUCKETS


PAGE = """<html><body><header class="site-header"><h1>Site</h1><p>Welcome, all, to, this, very, long header text that goes on.</p></header>
<div class="cookie-notice"><p>We use cookies, and, more, cookies, to improve things for everyone who reads.</p></div>
<div id="page"><div class="col"><div class="article-body"><h2>T &amp; T</h2><p>One, two,
 three is a long&nbsp;sentence of the text.</p><div class="ad-slot"><p>Buy, buy, buy</p></div><p>Second, para<br>graph here</p><ul><li>a item<li>b item</ul>
</div><aside>side, bar</aside></div><div class="sidebar"><p>links, many, links</p></div>
<section id="comments"><h3>Comments</h3><p>I think, you, are, wrong, and, so, on, for a long time yes indeed.</p></section>
<form><p>Name, mail</p></form></div><footer><p>c, d, e</p></footer><script>if (1 < 2) { "</p>" }</script></body></html>"""


@pytest.mark.parametrize(
    "html, text",
    [
        (PAGE, "T & T\nOne, two, three is a long sentence of the text.\nSecond, para graph here\na item\nb item"),
        ("<article><h1>T</h1><p><b>T<br></article><footer>no", "T\nT"),
        ("<p>only <b>text", "only text"), ("", ""), ("words, no tags", "words, no tags"), ("<div>" * 5000 + "x" + "</p>" * 5000, "x"),
        ("<nav>menu</nav><!-- c --><style>p{}</style>", ""), ("<p>a</p></article></div><p>b &lt;i&gt;", "a\nb <i>"),
        ("<main><section><p>One, long paragraph of the story, with commas.</p></section><section><p>End.</p></section></main><div>other</div>", "One, long paragraph of the story, with commas.\nEnd."),
        ("<article><header><h1>Head</h1></header><p>Text of it, here.</p><div class='comments'><p>No, no, no, never</p></div></article>", "Head\nText of it, here."),
        ("<div><p>Text, that is long enough, to be the main one of the page.</p></div><div class=links><ul><li><a href=/a>many words in a link</a><li><a href=/b>more words in a link</a></ul></div>", "Text, that is long enough, to be the main one of the page."),
        ("<table><tr><td>a<td>b<tr><td>c, d</table>", "a\nb\nc, d"),
        ("<div class='main has-sidebar'><div class='post-header'><h1>T</h1></div><p>One, two.</p><div class='post-comments'>x</div></div><div id='left-sidebar'>s</div>", "T\nOne, two."),
        ("<div><h1>T</h1><article><p>One, two, three.</p></article><div class='related'><p>More, of, it</p></div></div>", "T\nOne, two, three."),
        ("<div role=main><p>Text &eacute;&#233;&amp;lt; a&nbsp;b</p><div hidden><p>no</p></div><p style='display:none'>no</p></div>", "Text éé&lt; a b"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


SIX = [f"Paragraph {n} of the story, with commas, words and a length that prose has on any page of news." for n in range(6)]
STORY = "".join(f"<p>{p}</p>" for p in SIX)


@pytest.mark.parametrize(
    "name",
    ["content-with-sidebar", "layout-right-sidebar", "post-widget-area", "story-promo", "menu-open", "related-article-body", "ad-free",
     "main-content social-layout", "article-with-comments", "comments-open"],
)
def test_names_of_wrappers(name):
    """A wrapper named after furniture keeps the article; furniture within and beside it goes."""
    inner = f"<div class='{name}'>{STORY}<div class='ad'><p>Buy it, now, here.</p></div></div>"
    assert html_extract.main_text(inner) == "\n".join(SIX)
    beside = "<div class='sidebar'><p>Also, of interest, to you.</p></div><section id='comments'>" + "<p>I, for one, do not agree with any of it, at all.</p>" * 40 + "</section>"
    assert html_extract.main_text(inner + beside) == "\n".join(SIX)


def test_forms_and_furniture_alone():
    form = "<form id='aspnetForm'><input name=x><div class='menu'><p>One, two</p></div>{}<select><option>a</select></form>"
    assert html_extract.main_text("<body>" + form.format(STORY)) == "\n".join(SIX)
    assert html_extract.main_text(f"<div>{STORY}</div>" + form.format("<p>Your name, your mail.</p>")) == "\n".join(SIX)
    assert html_extract.main_text("<form><p>Name, mail</p></form>") == html_extract.main_text("<div class=banner><p>Buy, now</p></div>") == ""
    assert html_extract.main_text("<div class='page-sidebar'><main><p>Short, but main.</p></main><p>x</p></div>") == "Short, but main."


def test_extract(spark):
    rows = [(1, "u", PAGE, "x", 5), (2, None, None, "x", 5), (3, "v", "", "x", 5), (1, "u", PAGE, "x", 5)]
    done = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    got = [tuple(r) for r in done.collect()]
    text = html_extract.main_text(PAGE)
    assert sorted(got, key=str) == sorted([(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_leaks(docs, items):
    """Every passage against every item, without index or bounds."""
    words = {i: decontamination.words_of(t.encode()) for i, t in items if decontamination.words_of((t or "").encode())}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    frequency = {}
    for w in words.values():
        for x in set(w):
            frequency[x] = frequency.get(x, 0) + 1
    impact = {}
    for i, w in words.items():
        raw = {x: np.log1p((n - frequency[x] + 0.5) / (frequency[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(w)}
        impact[i] = {x: v / sum(raw.values()) for x, v in raw.items()}
    stride = max(2 * max(map(len, words.values())), 64)
    found = set()
    for d, t in docs:
        text = decontamination.words_of((t or "").encode())
        for at in range(0, len(text), stride):
            passage = text[at : at + 2 * stride]
            for i in words:
                if sum(v for x, v in impact[i].items() if x in set(passage)) < 0.6:
                    continue
                q, a = decontamination.question_and_answer(dict(items)[i].encode())
                g = decontamination.grams(q)
                have = decontamination.grams_of(passage, min(5, len(q)))
                if len(g & have) / len(g) >= 0.5 and (not a or sum(x in passage for x in a) / len(a) >= 0.5):
                    found.add((d, i))
    return found


def test_leaks(spark):
    r = random.Random(6)
    word = lambda: r.choice("ka lo mi nu pe ra si to vu xe".split()) + r.choice("ka lo mi nu pe ra si to vu xe".split())
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{text(r.randint(8, 30))}? {text(4)}.") for i in range(60)] + [(70, None), (71, ""), (72, "?!"), (73, "One sentence alone of words"), (5, "a repeated id, of other words.")]
    rows = [(i, text(r.randint(5, 400))) for i in range(40)]
    rows += [(100 + i, f"{text(50 * (i % 4))} {items[i][1].upper()}\n{text(30)}") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "..."), (203, text(30000) + " " + items[7][1] + " " + text(500)), (204, items[3][1].split("?")[0][:40])]
    # Repeated ids are left out of the plain version.
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, item_id int, score int")
    bench = lambda chosen: spark.createDataFrame([(i, t, 0) for i, t in chosen], "item_id long, text string, score int")
    want = plain_leaks(rows, items[:-1])
    assert {(100 + i, i) for i in range(20)} | {(203, 7)} <= want
    for shard in (2048, 16):
        got = decontamination.leaks(docs, bench(items[:-1]), shard=shard).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    clean = decontamination.clean_documents(docs, bench(items))
    assert clean.columns == docs.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted({i for i, _ in rows} - {d for d, _ in want})
    assert decontamination.leaks(docs, bench([])).count() == 0
    assert decontamination.leaks(docs.where("false"), bench(items)).count() == 0


def test_each_passage_is_judged_by_itself(spark):
    """The question alone in one place does not hide question and answer, a little changed, in another."""
    question, answer = [f"q{i}" for i in range(20)], ["alpha", "beta", "gamma", "delta"]
    item = " ".join(question) + "? " + " ".join(answer) + "."
    changed = " ".join([*question[:16], "x1", "x2", "x3", "x4", *answer])
    filler = lambda n: " ".join(f"other{i % 50}" for i in range(n))
    docs = spark.createDataFrame([(1, f"{' '.join(question)} {filler(400)} {changed}"), (2, f"{' '.join(question)} {filler(400)}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "something else of a few words? yes.")], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.answer_overlap) for x in decontamination.leaks(docs, bench).collect()] == [(1, 7, 1.0)]


def test_passages_do_not_depend_on_shards(spark):
    """A long item widens the passages of all items, whichever shard they are in."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(10)) + f"? answer{i} of{i}.") for i in range(30)] + [(90, " ".join(f"long{k}" for k in range(300)) + "? end.")]
    # The answer stands 150 words behind its question: within a passage of 600 words, not within one of 128.
    gap = " ".join(f"gap{k % 40}" for k in range(150))
    docs = spark.createDataFrame([(i, items[i][1].replace("? ", f" {gap} ")) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontamination.leaks(docs, bench, shard=n).collect())) for n in (2048, 8))
    assert one == many and [x[:2] for x in one] == [(i, i) for i in range(30)]


def test_repeated_items_are_searched_once(spark):
    items = spark.createDataFrame([(1, "the same item again")] * 100 + [(2, "another one")], "item_id long, text string")
    shards = list(decontamination.index_shards(items, shard=10))
    assert [texts for texts, *_ in shards] == [[(1, b"the same item again"), (2, b"another one")]]
    assert [x[2] for x in shards] == [101] and shards[0][1][b"same"] == 100


def test_shards_hold_all_items(spark):
    items = spark.createDataFrame([(i, f"word{i} and others") for i in range(100)], "item_id long, text string")
    seen = [i for texts, *_ in decontamination.index_shards(items, shard=10) for i, _ in texts]
    assert sorted(seen) == list(range(100))


def test_pipeline_keeps_and_drops(spark, tmp_path):
    r = random.Random(12)
    rows = [(i, "\n".join([f"Menu of {i % 4}"] + [sentence(r, lang, 40) for _ in range(3)]), lang, f"s{i % 4}") for i in range(80) for lang in [list(STOCK)[i % 3]]]
    item = "what would the people have under the water that night? their house was there."
    rows += [(500, rows[5][1], "fr", "s1"), (501, "123 456", "en", "s1"), (502, f"{sentence(r, 'en', 80)}\n{item}", "en", "s2"), (503, None, "en", None)]
    spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append({x.doc_id for x in docs.collect()})
    every = {x[0] for x in rows}
    assert counts[0] == counts[1] == every - {501, 503}
    assert not [x for x in docs.collect() if "Menu" in x.text]
    assert counts[2] == counts[1] - {500}
    assert counts[3] == counts[2] - {502}
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == counts[3]


def test_every_operator_has_a_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 11))


def test_many_languages(spark):
    """Seventy languages, the smallest of five documents: each is known."""
    r = random.Random(12)
    rows = []
    for n in range(70):
        syllables = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)]
        for _ in range(5 if n < 4 else 9):
            text = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(80))
            rows.append((len(rows), text, chr(97 + n // 26) + chr(97 + n % 26)))
    docs = spark.createDataFrame([(i, t, lang, f"host{i % 7}") for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: (x.language, x.accepted) for x in language_id.identify_documents(docs).collect()}
    assert got == {i: (lang, True) for i, _, lang in rows}


def test_sample_of_distinct_texts(spark):
    """A text with most of a language's rows is one text of the model."""
    once = [(f"aa bb {i}", "xx") for i in range(5)] + [("zz yy", "xx")]
    model = [language_id.fit(spark.createDataFrame(rows, "text string, lang string")) for rows in (once, once + [("zz yy", "xx")] * 300)]
    assert model[0][0] == model[1][0] == ["xx"] and (model[0][1] == model[1][1]).all()


def test_a_fit_starts_no_other_python_workers(spark, monkeypatch):
    """Rows that the driver makes in Python are unpickled by workers of another kind, which stay beside those of the stages."""
    docs = docs_of(spark, [(1, "das ist ein Haus", "de", "a"), (2, "this is a house", "en", "a"), (3, "that is a tree", "en", "b")])
    wanted = language_id.fit(docs)

    def refuse(*args, **kwargs):
        raise AssertionError("rows made in Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    names, table = language_id.fit(docs)
    assert names == ["de", "en"] and (table == wanted[1]).all()


def test_batches_of_the_pipeline_are_small(spark):
    class Conf:
        held = {"spark.sql.parquet.columnarReaderBatchSize": "64"}
        get, set = held.get, held.__setitem__

    class Session:
        conf = Conf

    corpus_pipeline.in_small_batches(Session)
    assert Conf.held == {"spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}
