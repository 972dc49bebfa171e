"""HTML extraction on planted pages; language ID by brute force and held-out accuracy."""

import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from platterlake.llm import html_text, language

SCHEMA = "doc_id bigint, text string, lang string, source string, found string"

FURNITURE = """<header class="site"><a href="/">Logo</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="ad-slot">Buy now, really.</div><aside>Side matter, with words.</aside><div id="cookie-notice">We use cookies, a lot.</div>"""
AFTER = """<div class="comments"><h3>Comments</h3><p>I disagree, strongly.</p></div><form>Name <input name=a> <button>Send</button></form>
<footer>&copy; 2020</footer><script>var t="</p>";</script><!-- <p>no</p> --><style>p{}</style>"""
ARTICLE = """<h1>A title</h1><p><b>First &amp; foremost,
 a paragraph.<br>Next line.<p>Second&#233;, with <a href="x">a link</a> and <i>em</i>phasis.</p><ul><li>An item, short</li><li>Other</li></ul><blockquote>Quoted words, here.</blockquote>"""
WANT = "A title\n\nFirst & foremost, a paragraph. Next line.\n\nSecondé, with a link and emphasis.\n\nAn item, short\n\nOther\n\nQuoted words, here."


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>", "<div id='story'>{}</div>", "<div><div>{}</div></div>"])
def test_planted_article(shell):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{FURNITURE}{shell.format(ARTICLE)}{AFTER}</body></html>"
    assert html_text.main_text(page) == WANT


def test_furniture_inside_the_article():
    page = f"<article>{ARTICLE}<div class='share-bar'>Share</div><aside>More</aside><section id=comments><p>Nice, really.</p></section></article>"
    assert html_text.main_text(page) == WANT


def test_article_in_main():
    page = f"<main><div class='crumbs'>Home, here</div><article>{ARTICLE}</article><div><p>Read on, please.</p></div></main>"
    assert html_text.main_text(page) == WANT
    assert html_text.main_text(f"<main><div>{ARTICLE}</div><article><p>A teaser.</p></article></main>").startswith(WANT)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<script>", "<!--", "&", "<nav>x</nav>", "</p></p>", "<b>" * 3000])
def test_no_article(page):
    assert html_text.main_text(page) in ("", "<", "&")


@pytest.mark.parametrize(
    "beside",
    [
        "<script>for(i=0;i<n;i++){} // don't\n</script>",
        "<script>var s='<!--';</script>",
        "<SCRIPT>if (a<b) x='</p>'</SCRIPT >",
        "<style>a:after{content:'<'}</style>",
        "<textarea><b it's</textarea>",
        "<svg><title/><style/></svg>",
        "<!-->",
    ],
)
def test_raw_text_does_not_swallow_the_page(beside):
    body = "<article><p>Body text. It's here.</p><p>More of it, isn't it.</p></article>"
    assert html_text.main_text(beside + body) == "Body text. It's here.\n\nMore of it, isn't it."


def test_quotes_open_values_only():
    page = "<article><p>One, <img alt=Bob's src=x> two three.</p><p title = 'a > b' lang=\"x>y\">Four, it's five.</p><p ' \">Six, isn't it.</p></article>"
    assert html_text.main_text(page) == "One, two three.\n\nFour, it's five.\n\nSix, isn't it."


@pytest.mark.parametrize(
    "around",
    [
        '<div style="overflow: hidden">{}</div>',
        '<div title="now hidden" data-x=\' hidden class="nav"\'>{}</div>',
        '<div class="layout has-sidebar">{}</div>',
        '<div class="no-sidebar comments-open search-result">{}</div>',
        '<div id="form-of-government">{}</div>',
        '<div class="widget">{}</div>',
        '<form id=aspnet>{}</form>',
        '<div hidden>{}</div>',
        '<html><head><title>A</title><meta name=x><body>{}',
    ],
)
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div id=story>{}</div>"])
def test_loose_marks_do_not_cut_the_article(around, shell):
    assert html_text.main_text(around.format(shell.format(ARTICLE))) == WANT
    assert html_text.main_text(FURNITURE + around.format(shell.format(ARTICLE)) + AFTER) == WANT


def test_names_that_mark():
    yes, no = "ad comments ad-slot cookie-notice share_bar site-footer comment-12 related-posts nav-list sidebar-left reader-comments main_nav page-footer copyright-notice".split(), "has-sidebar no-sidebar with-nav comments-open search-result form-of-government adverb header-image page-header article-header legally".split()
    assert [n for n in yes + no if html_text.names_no_article(n)] == yes
    assert html_text.attributes("<a b='c d' B=x hidden e = f/g h=\"i>j\"/>") == {"b": "c d", "hidden": "", "e": "f/g", "h": "i>j"}
    assert html_text.main_text(f"<article>{ARTICLE}<div hidden><p>Not seen, at all.</p></div><div aria-hidden=true>Nor this.</div></article>") == WANT


STORY = "".join(f"<p>Sentence {i} of the story, which is long enough; it goes on, and on, for a while. Then it ends.</p>" for i in range(6))
TOLD = "\n\n".join(f"Sentence {i} of the story, which is long enough; it goes on, and on, for a while. Then it ends." for i in range(6))


@pytest.mark.parametrize("card", ["<article class=teaser><h3>More</h3><p>Read this, too.</p></article>", "<article class=comment><p>I disagree, strongly.</p></article>" * 3, "<article><p>A card, short.</p></article>", "<div role=article><p>A card, short.</p></div>"])
@pytest.mark.parametrize("shell", ["<div class=story>{}</div>{}", "<form><div class=story>{}</div></form>{}", "<div class=story>{}{}</div>"])
def test_a_card_set_as_article_does_not_hide_the_story(shell, card):
    got = html_text.main_text(FURNITURE + shell.format(STORY, card) + AFTER)
    assert got.startswith(TOLD) and "disagree" not in got and "Read this" not in got


@pytest.mark.parametrize("name", "reader-comments user-comments article-comments responses comments page-footer main-nav promo-card sidebar-left related-articles more-stories right-rail left-column author-bio legal copyright".split())
@pytest.mark.parametrize("shell", ["<article>{}</article>{}", "<div class=content>{}</div>{}", "<div class=content>{}{}</div>", "{1}<div class=content>{0}</div>", "<article>{}{}</article>"])
@pytest.mark.parametrize("inner", ["<p>I disagree with this, strongly. It is not so.</p><p>Nor do I, for what it is worth.</p>", "Some text of it, here. And more, too."])
def test_qualified_names_are_beside_the_article(name, shell, inner):
    assert html_text.main_text(shell.format(STORY, f"<div class={name}>{inner}</div>")) == TOLD


@pytest.mark.parametrize("own", ["<p>See <a href=x>the long report of the board</a>.</p>", "<div class=pull>A quote that was pulled, here.</div>", "<blockquote>By <a href=x>someone who wrote it well.</a></blockquote>"])
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class=content>{}</div>"])
def test_linked_paragraphs_and_boxes_of_the_article_stay(own, shell):
    plain = " ".join(re.sub("<[^>]*>", "", own).split())
    assert html_text.main_text(shell.format(STORY + own + STORY)) == f"{TOLD}\n\n{plain}\n\n{TOLD}"


@pytest.mark.parametrize("deep", ["<li><div class=comment>x", "<div>a, b.", "<div class=ad>a, b.", "<article>a.<form>", "<b>a<i>", "<table><tr><td>a<p>"])
def test_depth_costs_no_more_than_length(deep):
    """A page four times as deep takes about four times as long, and 200 KB of nested elements few seconds."""
    took = []
    for n in (2_000, 8_000):
        began = time.process_time()
        html_text.main_text(deep * n)
        took.append(time.process_time() - began)
    assert took[1] < 3 and took[1] < 10 * took[0] + 0.5


def test_ratios_decide_inside_an_article():
    links = "<div class=x><a href=a>One</a> <a href=b>Two</a> or <a href=c>Three</a></div>"
    assert html_text.main_text(f"<article><h1>Title</h1>{STORY}{links}</article>") == "Title\n\n" + TOLD
    assert html_text.main_text(f"<div class=story>{STORY}</div><div class=comments>{STORY.replace('story', 'reply')}</div>") == TOLD


def test_extract_keeps_rows(spark):
    rows = [(1, "<p>Some words, here.</p>", None, None, "f"), (1, None, None, None, None), (None, "", None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, SCHEMA), "text").collect()
    assert sorted((str(r.row.doc_id), r.text) for r in got) == [("1", ""), ("1", "Some words, here."), ("None", "")]
    assert html_text.extract(spark.createDataFrame([], SCHEMA), "text").collect() == []


def test_path_ratios_prefer_prose():
    found = html_text.blocks("<div class=x><a>Home</a></div><div class=x><a>News</a></div><div><p>Prose, with marks. And more of it.</p><p>Prose, again: yes.</p></div>")
    scores = html_text.ratios(found)
    assert min(scores[2:]) > max(scores[:2])


def test_viterbi_brute_force():
    rnd = np.random.default_rng(3)
    for penalty in (0.5, 2.0):
        scores, lengths = rnd.normal(size=(40, 3)), np.array([5, 1, 7, 3, 1])
        ids = rnd.integers(0, 40, lengths.sum())
        got, at = language.viterbi(scores, ids, lengths, penalty), 0
        for n in lengths:
            part = scores[ids[at : at + n]]
            value = lambda p: sum(part[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731, B023
            best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(value(got[at : at + n]) - best) < 1e-9
            at += n


def test_grams_are_per_word():
    place, owner = language.grams(["ab", "c", "日本"])
    assert np.bincount(owner).tolist() == [10, 6, 10]
    alone = language.grams(["c"])[0]
    assert sorted(place[owner == 1]) == sorted(alone)


def test_held_out_accuracy_and_spans(spark):
    rnd = random.Random(6)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["str", "ing", "orp", "elk"], "ru": ["да", "не", "ил", "ом"]}
    text = lambda k, n: " ".join("".join(rnd.choice(parts[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(k := rnd.choice(list(parts)), rnd.randint(1, 60)), k, "s", "f") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs)
    assert model.languages == ["ru", "xx", "yy"]
    mixed = text("xx", 40) + " 12, " + text("yy", 18) + " — " + text("ru", 20)
    extra = [(900, mixed, None, None, None), (901, None, "xx", None, None), (902, "123 !? ²", None, None, None), (903, "İ " + rows[0][1], None, None, None), (904, "z" * 100_000, None, None, None), (905, "", None, None, None)]
    got = {r.row.doc_id: r.found for r in language.identify(spark.createDataFrame(rows + extra, SCHEMA), model).collect()}
    assert sum(got[r[0]].lang == r[2] for r in rows) >= 0.98 * len(rows)
    assert [(s.lang, mixed[s.start : s.end].split()[0], len(re.findall(r"[^\W\d]+", mixed[s.start : s.end]))) for s in got[900].spans] == [("xx", mixed.split()[0], 40), ("yy", mixed.split()[41], 18), ("ru", mixed.split()[60], 20)]
    assert got[900].lang == "xx" and 0 < got[900].score < 1
    assert [(got[i].lang, got[i].score) for i in (901, 902, 905)] == [("und", 0.0)] * 3
    assert got[903].lang == rows[0][2] and got[904].lang in model.languages
    none = language.train(docs.where("false"))
    assert [r.found.lang for r in language.identify(docs.limit(3), none).collect()] == ["und"] * 3
    few = language.train(docs, rows=60)
    assert few.languages == ["ru", "xx", "yy"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the provided tables")
def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs.where(language.held_out()), language.train(docs))
    right, n = got.where("row.lang = found.lang").count(), got.where("row.lang is not null").count()
    assert n > 100 and right >= 0.97 * n


def test_sampling_never_comes_to_nothing():
    for n in (1, 2_500, 10**6, 10**12, 10**16):
        found = language.limits({"aa": n, "bb": 3, "cc": 10**10, "dd": n}, 10_000)
        assert found["bb"] == 2**63 - 1
        assert 0.9 * min(n, 2_500) <= found["aa"] * n / 2**63 <= max(1.1 * 2_500, n if n <= 2_500 else 0)


def test_all_labelled_rows_count(spark):
    """More rows than a sample would have: the table and the least fit come from each of them."""
    rnd = random.Random(12)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(4)) for _ in range(40_000)]
    docs = spark.createDataFrame([(i, t, "xx" if i % 4 else "yy") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3)
    own = {x: np.zeros(language.TABLE) for x in ("xx", "yy")}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            np.add.at(own["xx" if i % 4 else "yy"], language.grams(t.split())[0], 1)
    model = language.train(docs)
    scripts = np.zeros((2, len(language.SCRIPTS)))
    scripts[:, language.SCRIPTS.index("latin")] = 1
    assert np.array_equal(model.table, language.Model(["xx", "yy"], np.array([own["xx"], own["yy"]]), scripts).table)
    found = language.identify(docs, model).cache()
    fits = [r.found.fit for r in found.collect() if zlib.crc32(str(r.row.doc_id).encode()) % 3 == 1]
    assert len(fits) > 13_000
    want = 2 * np.percentile(fits, 100 * language.ODD_SHARE) - np.mean(fits) - language.ROOM / len(fits)
    assert abs(language.least_fit(found, model) - want) < 1e-9


def test_words_are_folded_into_tables_when_there_are_many(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", "bb", "aa"]), pa.array(["one two three", "four five", "one six"])], names=["lang", "text"])
    whole = [b.to_pylist() for b in language._count(iter([batch, batch]))]
    monkeypatch.setattr(language, "KEPT_WORDS", 2)
    assert [b.to_pylist() for b in language._count(iter([batch, batch]))] == whole


def test_ranked(spark):
    rnd = random.Random(13)
    for values in ([-3.5], [-2.0] * 50, [-99.0, *[-rnd.random() for _ in range(3_000)], -1e-300, 0.0], [1.0, math.nextafter(1.0, 2.0), 1.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for rank in {0, 1 % len(values), len(values) // 2, len(values) - 1}:
            assert language.ranked(df, rank) == sorted(values)[rank]


def test_spans_where_lower_case_is_longer(spark):
    rows = [(i, "the small house is on the hill " * 3 if i % 2 else "das kleine Haus steht auf dem Berg " * 3, "en" if i % 2 else "de", None) for i in range(60)]
    schema = "doc_id bigint, text string, lang string, found string"
    model = language.train(spark.createDataFrame(rows, schema))
    text = "İİ İstanbul " + "the small house is on the hill " * 5 + "das kleine Haus steht auf dem Berg " * 5
    found = language.identify(spark.createDataFrame([(1, text, None, None)], schema), model).first().found
    last = found.spans[-1]
    assert len(found.spans) >= 2 and last.lang == "de" and text[last.start : last.start + 3] == "das" and text[: last.end] == text.rstrip()


PROSE = "The quick brown fox jumped over the lazy dog, and then it went home again. It was late, after all, and nobody minded."


def test_header_and_inline_marks_inside_an_article():
    lead = html_text.main_text(f'<article><div class="post-header"><h1>Title here</h1><p>A lead, short and good.</p></div><p>{PROSE}</p><p>{PROSE}</p></article>')
    assert lead == "\n\n".join(["Title here", "A lead, short and good.", PROSE, PROSE])
    line = html_text.main_text(f'<article><p>Before this <a class="share" href="#">linked word</a> after it, the text goes on, as it should.</p><p>{PROSE}</p></article>')
    assert line.startswith("Before this linked word after it, the text goes on")


def test_long_and_deep_pages():
    text = html_text.main_text("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>")
    assert text == "\n\n".join([PROSE] * 20_000)
    deep = html_text.main_text("".join(f"<div>{PROSE}" for _ in range(1500)))
    assert deep.split("\n\n")[-1] == PROSE and len(deep) > 1000 * len(PROSE)


def test_ratios_brute_force():
    """Scores against the definition, worked out block by block."""
    rnd = random.Random(11)
    page = "".join(f"<{t} class=c{rnd.randrange(3)}>{' '.join(rnd.choice(['word', 'stop.', 'so,', 'on']) for _ in range(rnd.randint(1, 30)))}<a>{'link ' * rnd.randint(0, 3)}</a></{t}>" for t in (rnd.choice(["p", "div", "li"]) for _ in range(60)))
    found = html_text.blocks(page)
    chars, marks = [], []
    for b in found:
        same = [x for x in found if x.path == b.path]
        chars.append(sum(max(0, len(x.text) - 2 * x.linked) for x in same) / len(same))
        marks.append(sum(len(re.findall(r"[.,;:!?]", x.text)) for x in same) / len(same))
    last = len(found) - 1
    for i, score in enumerate(html_text.ratios(found)):
        around = [max(i - 1, 0), i, min(i + 1, last)]
        text, punct = (0.25 * x[around[0]] + 0.5 * x[around[1]] + 0.25 * x[around[2]] for x in (chars, marks))
        assert abs(score - (text * (punct + 0.1)) ** 0.5) < 1e-9
