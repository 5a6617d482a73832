"""Language ID, toxicity, token counts, archives and page text."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import zlib
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrapanel.llm import html_text, langid, token_counts, toxicity, warc
from terrapanel.llm.common import scratch_path

from .helpers import documents, nothing, rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def speech(seed=2, n=160):
    rnd = random.Random(seed)
    kinds = {"aa": ["tha", "ther", "ing", "wo", "and"], "bb": ["él", "ción", "ndo", "ra", "que"], "cc": ["ß", "ung", "ich", "der", "sch"]}
    out = []
    for i in range(n):
        lang = rnd.choice(list(kinds))
        out.append((i, " ".join("".join(rnd.choice(kinds[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(2, 40))), lang))
    return out


def brute_kn(texts_by_lang):
    """Interpolated Kneser-Ney over dictionaries, straight from the formulas."""

    def symbols(t):
        return " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())

    models, alphabet = {}, set()
    for lang, texts in texts_by_lang.items():
        top = Counter()
        for t in texts:
            s = symbols(t)
            # the last word ends with the text, or with what follows it
            s += " " if t and not t[-1].isalpha() and s else ""
            padded = " " * 3 + s
            top.update(padded[i - 3 : i + 1] for i in range(3, len(padded)))
        orders = {4: top}
        for k in (3, 2, 1):
            orders[k] = Counter(g[1:] for g in orders[k + 1])
        models[lang] = orders
        alphabet |= set(orders[1])
    uniform = 1 / (len(alphabet) + 1)

    def p(lang, gram):
        if not gram:
            return uniform
        counts = models[lang][len(gram)]
        once, twice = (sum(v == n for v in counts.values()) for n in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        follow = [v for g, v in counts.items() if g[:-1] == gram[:-1]]
        if not follow:
            return p(lang, gram[1:])
        return max(counts[gram] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(lang, gram[1:])

    def bits(lang, t):
        s = symbols(t) + (" " if not t[-1].isalpha() else "")
        padded = " " * 3 + s
        return -sum(math.log2(p(lang, padded[i - 3 : i + 1])) for i in range(3, len(padded))) / len(s)

    return bits


def test_kneser_ney_equals_the_formulas():
    every = speech(n=60)
    by_lang = defaultdict(list)
    for _, t, lang in every:
        by_lang[lang].append(t)
    counts = {}
    for lang, texts in by_lang.items():
        key, n = np.unique(np.concatenate([langid.grams(*langid.symbols([t])[:2]) for t in texts]), return_counts=True)
        counts[lang] = (key, n)
    model = langid.KneserNey(counts)
    bits = brute_kn(by_lang)
    probe = [every[0][1], "Zebra 99 quux!", "der die das", "thë x"]
    got, letters = model.cross_entropy(probe)
    for t, row in zip(probe, got, strict=True):
        assert row == pytest.approx([bits(lang, t) for lang in model.langs], abs=1e-3)
    assert letters.all()


def test_symbols_of_many_texts_are_those_of_each(monkeypatch):
    texts = [t or "" for _, t in rows()]
    one = [langid.symbols([t]) for t in texts]
    sequence, counts, has = langid.symbols(texts)
    assert sequence.tolist() == np.concatenate([o[0] for o in one]).tolist()
    assert counts.tolist() == [int(o[1][0]) for o in one] and has.tolist() == [bool(o[2][0]) for o in one]
    assert langid.grams(sequence, counts).tolist() == np.concatenate([langid.grams(o[0], o[1]) for o in one]).tolist()


def test_identify(spark):
    extra = [(900, None, "aa"), (901, "12 -- 🙂", "aa"), (902, "", None), (None, "ther tha wo", "aa"), (903, "ther ther tha wo and", None), (903, "ther ther tha wo and", None)]
    table = spark.createDataFrame([(i, t, g, "x") for i, t, g in [*speech(), *extra]], "doc_id long, text string, lang string, score string")
    got = langid.identify(table).collect()
    assert len(got) == len(speech()) + len(extra)
    by_id = {r.doc_id: r for r in got}
    truth = {i: g for i, _, g in speech()}
    assert np.mean([by_id[i].lang_pred == g for i, g in truth.items() if held(i)]) > 0.97
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert {by_id[i].lang_pred for i in (900, 901, 902)} == {"und"} and by_id[903].lang_pred == "aa" and by_id[None].lang_pred == "aa"
    assert langid.identify(table.limit(0)).count() == 0
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_non_negative_risk_finds_the_positives():
    rnd = np.random.default_rng(0)
    make = lambda n, toxic: np.column_stack([rnd.random(n) < (0.8 if toxic else 0.01), rnd.random((n, 3)) < 0.5]).astype(np.float32)
    positive = make(300, True)
    unlabelled = np.concatenate([make(900, False), make(100, True)])
    w, b = toxicity.fit(positive, unlabelled, 0.1)
    score = 1 / (1 + np.exp(-(make(500, True) @ w + b)))
    clean = 1 / (1 + np.exp(-(make(500, False) @ w + b)))
    # four in five positives show the one feature that tells
    assert (score >= 0.5).mean() > 0.7 and (clean >= 0.5).mean() < 0.05


def test_toxicity(spark):
    rnd = random.Random(4)
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs, labels = [], []
    for i in range(600):
        bad = i % 8 == 0
        words = [rnd.choice(plain) for _ in range(30)] + (rnd.sample(["scumlet", "scumling", "moronic", "idiotes", "idiotan"], 3) if bad else [])
        docs.append((i, " ".join(words), 1.0))
        if i % 3:
            labels.append((i, 1 if bad else 0, 1, "x"))
    docs += [(601, None, 1.0), (602, "", 1.0), (None, "scumlet moronic idiotes", 1.0), (603, docs[8][1], 1.0), (603, docs[8][1], 1.0)]
    labels += [(8, 1, 1, "x"), (None, 1, 1, "x"), (5000, None, 1, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")
    got = toxicity.toxicity(d, marks).collect()
    assert len(got) == len(docs)
    kept = [(r.predicted == 1) == (r.doc_id % 8 == 0) for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert np.mean(kept) > 0.97
    assert {(r.score, r.predicted) for r in got if r.doc_id in (601, 602)} == {(min(r.score for r in got), 0)}
    assert all(r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    assert {r.score for r in toxicity.toxicity(d, marks.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), marks).count() == 0


RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute_sections(parts, separator="\n", by_line=True):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    starts, at = [], 0
    for t in parts:
        starts.append(at)
        if by_line:
            starts += [at + k + 1 for k, c in enumerate(t) if c == "\n"]
        at += len(t) + len(separator)
    whole = separator.join(parts)
    ends = [*starts[1:], len(whole)]
    n = [0] * len(starts)
    spans = tokenizer.encode(whole, add_special_tokens=False).offsets
    for a, b in spans:
        shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
        n[shares.index(max(shares))] += 1
    return list(zip(starts, ends, n, [len(spans)] * len(n), strict=True))


def test_section_counts_equal_the_offsets(spark):
    extra = [(600, "a\n\n\nb\n"), (601, "x  \n  y\n\n"), (602, "<|endoftext|>\n中文 😀\né")]
    got = defaultdict(list)
    for r in token_counts.section_token_counts(documents(spark, extra), RANKS, PATTERN).orderBy("section").collect():
        got[r.doc_id].append((r.start, r.end, r.n_tokens, r.doc_tokens))
    want = defaultdict(list)
    for i, t in rows(extra):
        want[i] += brute_sections([t or ""])
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert token_counts.section_token_counts(nothing(spark), RANKS, PATTERN).count() == 0


def test_fields_and_the_rule_for_crossing_tokens(spark):
    table = spark.createDataFrame([(1, "good", "morn", "ing"), (2, None, "", "x")], "id long, a string, b string, c string")
    got = token_counts.section_token_counts(table, RANKS, PATTERN, id_col="id", fields=["a", "b", "c"], separator="", by_line=False).orderBy("id", "section").collect()
    assert [r.field for r in got] == ["a", "b", "c"] * 2
    assert [(r.start, r.end, r.n_tokens, r.doc_tokens) for r in got if r.id == 1] == brute_sections(["good", "morn", "ing"], "", False)
    owner, crossing = token_counts.allocate(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 4, 7]))
    assert owner.tolist() == [0, 0, 2] and crossing.tolist() == [False, True, True]  # ties go to the earlier


PAGES = [(1, "http://a/", "<p>x</p>" * 50), (2, "http://b/\r\nX: y", "<p>x</p>" * 50), (3, None, None), (4, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "z" * 3_000_000), (None, "u", "q"), (None, "u", "é\r\n\r\nWARC/1.1\r\n")]


def pages(spark):
    return spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, least):
    got = sorted((r.id or "", r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or "") for r in warc.round_trip(pages(spark), min_bytes=least).collect())
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[(h or "").encode()].append(i)
    want = []
    for payload, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        for i in ids:
            alone = i == last or len(payload) < least
            want.append((str(i) if i is not None else "", "response" if alone else "revisit", len(payload), b32encode(hashlib.sha1(payload).digest()).decode(), "" if alone else str(last)))
    assert got == sorted(want)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_every_record_is_its_own_member(spark):
    archives = warc.write_monolithic(warc.with_revisits(pages(spark)), scratch_path(spark, "w"))
    index = warc.normalise(archives, scratch_path(spark, "n"))
    rows_ = index.collect()
    assert len(rows_) == len(PAGES)
    whole = b"".join(gzip.decompress(open(r.path.removeprefix("file://"), "rb").read()) for r in archives.collect())
    by_path = defaultdict(list)
    for r in rows_:
        by_path[r.path].append(r)
    again = b""
    for path, own in by_path.items():
        raw = open(path.removeprefix("file://"), "rb").read()
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and own[-1].offset + own[-1].length == len(raw)
        again += b"".join(zlib.decompress(raw[r.offset : r.offset + r.length], wbits=31) for r in own)
    assert sorted(whole.split(b"WARC/1.1\r\n")) == sorted(again.split(b"WARC/1.1\r\n"))
    payloads = {r.id: r.payload for r in warc.read_records(index, with_payload=True).collect()}
    assert payloads["8"] == b"z" * 3_000_000


def test_a_shared_folder_needs_no_scheme_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert ":" not in scratch_path(spark, "w")
    assert warc.archive_folder(spark, "w").startswith("file:/")
    assert warc.round_trip(pages(spark)).count() == len(PAGES)


def test_a_mount_table_is_followed(spark, tmp_dir, monkeypatch):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.warc.link./in", f"file://{tmp_dir}")
    monkeypatch.setattr(warc, "scratch_path", lambda _, name: f"viewfs://warc/in/{name}")
    assert warc.archive_folder(spark, "w") == f"file:{tmp_dir}/w"
    assert warc.round_trip(pages(spark)).count() == len(PAGES)


@pytest.mark.parametrize("step", ["write", "normalise"])
def test_tasks_refuse_a_folder_that_only_the_driver_has(spark, tmp_dir, monkeypatch, step):
    archives = warc.write_monolithic(warc.with_revisits(pages(spark)), scratch_path(spark, "w"))
    monkeypatch.setattr(warc, "_make", lambda *_: None)  # made on another disk
    with pytest.raises(Exception, match="all machines share"):
        if step == "write":
            warc.write_monolithic(warc.with_revisits(pages(spark)), f"{tmp_dir}/other")
        else:
            warc.normalise(archives, f"file:{tmp_dir}/other")


def test_broken_archives_are_refused():
    good = warc.record("1", "u", b"abc", "D", None, "2000-01-01T00:00:00Z")
    for bad in (good[:-2], good[:40], b"x" + good):
        with pytest.raises(ValueError):
            list(warc.split_records(iter([bad])))

    class Stream:
        def __init__(self, raw):
            self.parts = [raw]

        def read(self, _):
            return self.parts.pop() if self.parts else b""

    with pytest.raises(ValueError):
        list(warc.inflated(Stream(gzip.compress(b"abc" * 1000)[:-9])))
    assert b"".join(warc.inflated(Stream(gzip.compress(b"a") + gzip.compress(b"b")))) == b"ab"


def test_main_text_of_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header>H</header><nav><ul><li>m</ul></nav>
      <div class="cookie-notice">c</div><div id="content"><h2>T&eacute; &amp; &lt;b&gt;</h2><p>one<br>two <a href=x>l</a><b>i</b>nk.<p>three
      <script>if (a < b) "</p>"</script><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><!-- <p>no</p> --><pre> x  y </pre></div>
      <section class="comments"><p>bad</p></section><form>f<input></form><aside>s</aside><footer>&copy;</footer>"""
    assert html_text.main_text(page).split("\n") == ["Té & <b>", "one two link.", "three", "a", "b", "1", "2", "3", "x y"]
    assert html_text.main_text("") == html_text.main_text("<p> </p>") == ""
    assert html_text.main_text("plain &amp; simple") == "plain & simple"
    assert html_text.main_text("<div>out</div><article><h1>A</h1><p>b<div class='share'>s</div><article class=comment>c</article></article>") == "A\nb"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_text.main_text(deep) == "x"


def test_class_words_do_not_cost_the_main_text():
    body = "<p>One two three four five.</p>"
    for attrs in ['class="post has-sidebar"', 'style="overflow:hidden"', 'data-id="login"', 'title="a hidden gem"', "title='class=ad'", 'data-x=1 alt="id=\'menu\'"']:
        for tag in ("article", "main", "div", "section"):
            assert html_text.main_text(f"<div class=ad>x</div><{tag} {attrs}>{body}</{tag}>") == "One two three four five.", (tag, attrs)
    assert html_text.main_text(f'<article><div class="entry-header"><h1>T</h1></div>{body}<div id=login>l</div></article>') == "T\nOne two three four five."
    assert html_text.main_text(f"<div class=with-sidebar><main class=search>{body}</main><div class=sidebar>s</div></div>") == "One two three four five."
    # marks go on to hold for the rest
    assert html_text.main_text(f"<article>{body}</article><div id=comments><article>c</article></div><p hidden>h") == "One two three four five."
    assert html_text.main_text(f"<div hidden>h</div><p ROLE=alert>r</p><p aria-hidden='true'>a</p>{body}<div class=comments>{body * 3}</div>") == "One two three four five."


def test_article_text_that_words_or_tags_once_cost():
    body = "<p>One two three four five.</p>"
    assert html_text.main_text(f'<article>{body}<section class="search-history"><p>Kept.</p></section></article>') == "One two three four five.\nKept."
    assert html_text.main_text(f'{body}<div class="share-prices"><p>Kept.</p></div><div class="share-buttons">s</div>') == "One two three four five.\nKept."
    assert html_text.main_text(f"<header>Site</header><article><header><h1>Headline</h1></header>{body}</article>") == "Headline\nOne two three four five."
    assert html_text.main_text("<p>Press the <label>red</label> key <math><mi>x</mi></math> now.</p>") == "Press the red key x now."


def test_class_words_count_where_their_shape_recurs(spark):
    """The same box with other words: deleted on a host that has it often,
    kept where one page alone has such a class."""
    body = "<p>Body {} of a page that goes on for a while.</p>"
    often = lambda i: f'<body>{body.format(i)}<div class="site-promo-{"x"}"><b>Buy {i}</b></div><div class="comments"><p>{"Word " * 60}{i}</p></div><div><ul><li><a>{i}</a><li><a>b{i}</a><li><a>c{i}</a></ul></div></body>'
    once = '<body><p>Body.</p><div class="search"><p>On searching, at length.</p></div><div class="promo-history"><p>Long ago.</p></div></body>'
    made = [(i, f"http://a/{i}", often(i)) for i in range(8)] + [(50, "http://a/50", once)]
    made += [(100 + i, f"http://few/{i}", often(i)) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Body {i} of a page that goes on for a while." for i in range(8))
    assert got[50] == "Body.\nOn searching, at length.\nLong ago."
    # too few pages to judge by: whole tokens alone
    assert got[101] == "Body 1 of a page that goes on for a while.\nBuy 1\n1\nb1\nc1"


def test_template_subtrees_are_removed(spark):
    made = [(i, f"http://Site.example:80/{i}", f"<body><div><span>Our site</span> since 1999</div><div><p>Body {i} text.</p><p>Licence text.</p></div><div>Ring us</div></body>") for i in range(12)]
    made += [(100 + i, f"http://other/{i}", f"<body><div>Our own {i}</div><p>Licence text.</p></body>") for i in range(3)]  # too few pages
    made += [(200 + i, f"http://art/{i}", f"<body><div>Top</div><article><p>{i}</p><p>Licence text.</p></article></body>") for i in range(9)]
    made += [(300 + i, "http://copies/", "<body><div>All the same</div></body>") for i in range(6)]
    made += [(400, None, None), (401, "", ""), (401, "", ""), (None, "nonsense", "<p>x")]
    table = spark.createDataFrame([(*p, "x") for p in made], "page_id long, url string, html string, host string")
    got = html_text.extract(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(made)
    by_id = {r.page_id: r.text for r in got.collect()}
    assert by_id[3] == "Body 3 text." and by_id[101] == "Our own 1\nLicence text."
    assert by_id[204] == "4\nLicence text." and by_id[302] == "All the same" and by_id[400] == by_id[401] == "" and by_id[None] == "x"
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert html_text.extract(table.limit(0)).count() == 0


def test_templates_within_and_beside_the_main_element(spark):
    """Boxes that recur within an article go, shared passages stay; a stray
    article doesn't replace the body."""
    box = "<div><p>Read our other pieces</p><ul><li>One<li>Two</ul></div>"
    made = [(i, f"http://in/{i}", f"<body><article><h1>T{i}</h1><div><p>Body {i} of the long article.</p></div><p>Licence text.</p>{box}</article></body>") for i in range(8)]
    made += [(100 + i, "http://copies/", "<body><article><h1>A</h1><div><p>The same in every copy.</p></div></article></body>") for i in range(8)]
    body = "The page has its whole body in a division, of which the next words are the number {}, and it goes on for long."
    made += [(200 + i, f"http://stray/{i}", f"<body><div>Top</div><div>{body.format(i)}</div><article>Teaser {i}</article></body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    want = {i: f"T{i}\nBody {i} of the long article.\nLicence text." for i in range(8)} | {100 + i: "A\nThe same in every copy." for i in range(8)}
    assert got == want | {200 + i: f"{body.format(i)}\nTeaser {i}" for i in range(8)}


def test_a_section_of_a_large_host_has_a_template(spark):
    """What recurs on many pages goes, however many pages the host has."""
    made = [(i, f"http://big/{i}", f"<body><p>Body {i}.</p>" + ("<div>Section box</div>" if i % 10 == 0 else "<p>Twice.</p>" if i in (1, 2) else "")) for i in range(300)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Body {i}." + ("\nTwice." if i in (1, 2) else "") for i in range(300)}
