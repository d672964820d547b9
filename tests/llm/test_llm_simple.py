"""Quality rules, BPE, language id, main text and WARC against plain versions."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.fs as pafs
import pytest
import tiktoken

from lectern.llm import bpe, langid, main_text, warc
from lectern.llm.quality import RULES, Rule, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "a b c a b c a b c\n\n a b c ",
    "x\ny\nx\n \nx",
    "tab\tnew\x0bline\x0cand\rmore  spaces ",
    "# * $ % & | < > ### done",
    "ünïcödé wörter und mehr " * 40,
    "the of and to in is it for " * 30 + "\n- a\n- b\n* c",
    " ".join(f"word{i} the next{i} of last{i}" for i in range(40)),
    " ".join(f"word{i} the next{i} of last{i}" for i in range(40)),
    "word " * 30_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")


def plain_quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def test_quality_counts(docs):
    for row in quality(docs).collect():
        expected = plain_quality(row.text)
        assert {k: row[k] for k in expected} == expected
        assert row.kept == (not row.base_failed and not row.failed)


def test_quality_verdicts_and_table(docs, spark):
    kept = {r.doc_id for r in quality(docs).where("kept").collect()}
    assert kept == {10, 11}
    strict = quality(docs, rules=(Rule("short", "n_words", 0, 10),)).where("doc_id = 10").first()
    assert strict.failed == ["short"] and not strict.kept
    assert quality(docs, rules=()).where("kept").count() >= len(kept)
    assert quality(docs.limit(0)).count() == 0
    assert len(RULES) >= 5


def test_quality_is_one_projection(docs):
    plan = quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def reference_coder():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["a  b", " a b", "a b ", "a\n\nb", "a\nb c\n", "x \ny", "don't it's\nwe'll", "a\tb c", "a\x1cb c", "<|endoftext|> a", "日本語😀" * 50]


def test_bpe_equals_library(spark, reference_coder):
    path, library = reference_coder
    long_runs = ["a" * 3000, "=-" * 700, "abcdefgh" * 300, " " * 700 + "x"]
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, *ODD, *long_runs])]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN)
    for row in bpe.decode(encoded, path, public_tokenizers.PATTERN).collect():
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    made = {r.doc_id: r for r in bpe.digests(df, path, public_tokenizers.PATTERN, keep=["doc_id"]).collect()}
    both = {r.doc_id: r for r in bpe.tokens(df, path, public_tokenizers.PATTERN, keep=["doc_id"]).collect()}
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        assert made[i].n_tokens == both[i].n_tokens == len(ids) and both[i].ids == ids
        assert made[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert made[i].decoded_sha256 == both[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_language_id(spark):
    samples = {"en": "the cat and the dog of this house", "de": "der hund und die katze von diesem haus", "fr": "le chat et la maison de ce chien"}
    rows = [(i, f"{t} {i}", k, "s") for i in range(40) for k, t in samples.items()] + [(999, "nichts", None, "s"), (1000, None, "de", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, max_rows=60)
    asked = [
        (1, "the dog"), (2, "die katze"), (3, "la maison"), (4, None), (5, ""), (6, "123 !!"), (7, "katzenhaus hunde"), (8, "the " * 9000),
        (9, "日本語"), (1, "the dog"), (None, "la maison"),
    ]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["en", "de", "fr", "und", "und", "und", "de", "en", "fr"]
    assert all(0 <= r.score <= 1 for r in got) and by_id[4].score == 0
    assert len(got) == len(asked)
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty, keep=["doc_id"]).collect()} == {"und"}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy, buy, buy this now</div>
<div class="cookie-notice"><p>We use cookies, many of them, all the time.</p></div>
<article><h1>Head &amp; line</h1><p>First   paragraph,
with <b>bold text<br>and &eacute;.<p>Second one.<form><p>Name</p><input></form><aside>Side, bar, text</aside></article>
<section id="comments"><p>Nice article, I liked it, really, a lot.</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text_cases():
    assert main_text.main_text(PAGE) == "Head & line First paragraph, with bold text and é. Second one."
    divs = "<body><div class=menu><a href=x>One</a></div><div id=c><p>Some text, with commas, long enough.</p><p>More, text.</p></div><div><a href=y>links links links</a></div>"
    assert main_text.main_text(divs) == "Some text, with commas, long enough. More, text."
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<script>x</script>") == ""
    assert main_text.main_text("plain words only") == "plain words only"
    assert main_text.main_text("<p>a < b and <broken") == "a < b and <broken"
    assert main_text.main_text("<article>" + "<p>x, y.</p>" * 5000 + "</article>") == " ".join(["x, y."] * 5000)


def test_main_text_table(spark):
    rows = [(1, "u", PAGE, "old", 1), (2, None, None, "old", 2), (1, "u", PAGE, "old", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = main_text.extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars == len(r.text)) for r in got] == [(1, "u", True), (2, None, True), (1, "u", True)]
    assert got[1].text == "" and main_text.extract(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é same</p>" * 200
    rows = [(1, "http://a/x y\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (9, "z", big), (7, "q", "\r\n\r\n" * 600)]
    rows += [(None, "n", "null id"), (3, "u", "small"), (10, "l", "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archives = warc.write(df, str(tmp_path / "w"))
    got = warc.read(archives).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    want = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert r.payload_bytes == len(want[r.page_id])
        assert r.payload_digest == hashlib.sha1(want[r.page_id]).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == want[r.page_id] and r.refers_to is None
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(1, 9), (2, 9)}
    assert next(r.target for r in got if r.page_id == 1) == "http://a/x y\n"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_targets_come_back(spark, tmp_path):
    urls = ["http://a/x%20y", "http://a/b%2Fc", "http://a/100%", "a b%20c", "é%C3%A9", " %0d%0a\r\n", "%", "", None]
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.target for r in warc.round_trip(df).collect()} == dict(enumerate(urls))
    assert b"WARC-Target-URI: http://a/x%20y\r\n" in warc.record("response", 1, "http://a/x%20y", b"")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert {r.page_id: r.target for r in warc.round_trip(pages).collect()} == {r.page_id: r.url for r in pages.collect()}


def test_warc_members_and_damage(spark, tmp_path):
    archives = warc.write(spark.createDataFrame([(1, "u", "a" * 5000), (2, "v", "b")], "page_id long, url string, html string").coalesce(1), str(tmp_path))
    path = archives.first().path.replace("file:", "")
    data = open(path, "rb").read()
    members, rest = 0, data
    while rest:
        one = zlib.decompressobj(31)
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, members = one.unused_data, members + 1
    assert members == 3
    plain = warc.record("response", 1, "u", b"hello")
    (tmp_path / "bad").write_bytes(warc._member(plain.replace(b"hello", b"jello")))
    with pafs.LocalFileSystem().open_input_stream(str(tmp_path / "bad"), compression=None) as stream:
        (row,) = warc.records(stream)
    assert row[6] is False
    (tmp_path / "short").write_bytes(warc._member(plain)[:-30])
    with pytest.raises(Exception), pafs.LocalFileSystem().open_input_stream(str(tmp_path / "short"), compression=None) as stream:
        list(warc.records(stream))


ARTICLE = "<p>" + "This is a sentence of the article, with commas, and more words. " * 4 + "</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "layout with-sidebar", "no-comments post", "fixed-header page", "post social-post"])
def test_names_hide_no_article(name):
    text = main_text.main_text(f"<p>{ARTICLE}</p>")
    assert text.startswith("This is")
    side = "<div class='sidebar'><p>Other things.</p></div>"
    remarks = "<div id='comments'><article><p>A reader, who says no.</p></article></div>"
    assert main_text.main_text(f"<body><div class='{name}'>{ARTICLE}</div>{side}</body>") == text
    assert main_text.main_text(f"<body><div class='{name}'><article>{ARTICLE}</article>{remarks}</div></body>") == text


def test_names_do_not_count_if_they_leave_nothing():
    halves = "".join(f"<div class='widget'><p>Half a page, number {k}.</p></div>" for k in (1, 2))
    assert main_text.main_text(f"<body>{halves}</body>")


def test_self_closed_svg_ends_at_its_tag():
    text = main_text.main_text(ARTICLE)
    assert main_text.main_text(f"<body><svg viewBox='0 0 1 1'/><div>{ARTICLE}</div></body>") == text
    assert main_text.main_text(f"<body><svg class='a/b'><path d='z'/>gone</svg><div>{ARTICLE}</div></body>") == text


PARAGRAPH = "<p>A long sentence, with commas, of the article, goes here and on.</p>"
COMMENT = "<p>What readers say, at length, and again, is a comment.</p>"
PARTS = ["nav", "sidebar", "comments", "reviews", "button", "noscript", "form"]


def plain_part(kind):
    """HTML of a part that is no article."""
    return {
        "nav": "<nav><a href=/>Home</a> <a href=/x>Other</a></nav>",
        "sidebar": f"<div class='side-bar'>{COMMENT}</div>",
        "comments": f"<div id=comments>{COMMENT * 9}</div>",
        "reviews": f"<section class='user-reviews'>{COMMENT * 5}</section>",
        "button": "<button class=b><span>Menu</span></button>",
        "noscript": "<noscript><p>Please turn scripts on.</p></noscript>",
        "form": "<form><select><option>One<option>Two</select><input></form>",
    }[kind]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div id=content>{}</div>", "<div class='post has-comments'>{}</div>"])
@pytest.mark.parametrize("kind", PARTS)
def test_planted_parts_go_in_all_orders(frame, kind):
    body = frame.format(PARAGRAPH * 3)
    wanted = " ".join([PARAGRAPH[3:-4]] * 3)
    for other in PARTS:
        for order in itertools.permutations([body, plain_part(kind), plain_part(other)]):
            assert main_text.main_text("<body>" + "".join(order) + "</body>") == wanted


def test_unclosed_controls_captions_and_headlines():
    one = PARAGRAPH[3:-4]
    for tag in ("button", "select", "object", "iframe", "noscript"):
        for frame in ("<article>{}</article>", "<main><h1>T</h1>{}</main>"):
            assert one in main_text.main_text(f"<body><div><{tag} a=b>x</div>{frame.format(PARAGRAPH)}</body>")
    assert main_text.main_text(f"<article>{PARAGRAPH}<figure><img><figcaption>Cap</figcaption></figure></article>") == one + " Cap"
    for frame in ("<article>{}</article>", "<div class=content>{}</div>"):
        assert main_text.main_text(f"<body><h1>Head</h1>{frame.format(PARAGRAPH * 2)}</body>") == f"Head {one} {one}"
        assert main_text.main_text(f"<body><h1><a href=/>Site</a></h1>{frame.format(PARAGRAPH * 2)}</body>") == f"{one} {one}"
    # a part of the article may be named like comments are
    assert main_text.main_text(f"<article>{PARAGRAPH}<section id=discussion>{PARAGRAPH}</section></article>") == f"{one} {one}"
    assert main_text.main_text(f"<article>{PARAGRAPH}</article><div class=comments><article>{COMMENT * 9}</article></div>") == one
    # many controls that are not closed take no long time
    assert one in main_text.main_text("<button>" * 20_000 + f"<article>{PARAGRAPH}</article>")
