"""Operators of the training-data pipeline against brute force, exact round trips and held-out accuracy."""

import hashlib
import html.parser
import itertools
import json
import math
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, decontaminate, html_text, ngram_join, pii, secrets, sharding, topk, toxicity
from docloom.llm.common import store
from docloom.llm.components import connected_components
from docloom.llm.words import PIECE, Splitter

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(VOCAB)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})

#: Extra columns whose names clash with what operators make; odd texts; a repeated row.
CLASHING = "doc_id bigint, text string, lang string, score double, id string, key string, size string, n_tokens string, node string, label string, x string"
ODD = [None, "", " \n", "word", "one two three four five six seven", "é" * 50, "a" * 30000, "中 文 \U0001f600", "+1 (743) 555-3824 a@b.c 1.2.3.4", "same text here now and then", "same text here now and then"]


def odd_documents(spark):
    rows = [(k, t, None, 0.5, "i", "k", "s", "n", "q", "l", "x") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], rows[4]], CLASHING)


def empty_documents(spark):
    return odd_documents(spark).where("false")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---------------------------------------------------------------------- 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>First   <b>bold</b> text<br>goes&nbsp;on &#233;.<p>Second, unclosed <a href="x">link</a>.</p><aside>Side</aside><form><p>Field</p></form><div class="comments"><p>Nice!</p></div></article><footer>Foot</footer>"""


def test_html_keeps_the_article_only():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst bold text goes on é.\n\nSecond, unclosed link."
    plain = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert html_text.main_text(plain) == html_text.main_text(PAGE)


def test_html_keeps_what_lies_beside_the_core_under_the_body():
    five, four = ("".join(f"<p>{c} {k} is a whole sentence of the article that goes on for a while.</p>" for k in range(n)) for c, n in (("First", 5), ("Second", 4)))
    got = html_text.main_text(f'<body><h1>T</h1><div>{five}</div><div>{four}</div><div class="menu"><a href="/">Menu</a></div></body>')
    assert got.split("\n\n")[0] == "T" and got.count("First") == 5 and got.count("Second") == 4 and "Menu" not in got


def test_html_tags_and_roles_alone_do_not_empty_a_page():
    text = "".join(f"<p>Sentence {k} of the article, which is long enough to count.</p>" for k in range(4))
    controls = '<label>Name</label><input name="q"><select><option>One</option></select><button>Send</button><textarea>typed</textarea>'
    menu, foot = '<nav><a href="/">Menu</a></nav>', "<footer><p>All rights reserved, 2024.</p></footer>"
    for page in (
        f'<body><form id="aspnetForm"><main><h1>T</h1>{text}</main>{controls}</form>{foot}</body>', f'<body><form id="aspnetForm">{menu}<h1>T</h1>{text}{controls}</form>{foot}</body>',
        f'<body><form><div><div>{menu}<h1>T</h1>{text}</div></div>{controls}</form></body>', f'<body><nav><a href="/">Menu</a><article><h1>T</h1>{text}</article></body>',
        f'<body><div role="dialog"><article><h1>T</h1>{text}</article></div>{foot}</body>', f'<body><div aria-hidden="true"><h1>T</h1>{text}</div>{foot}</body>',
        f'<body><article><header><h1>T</h1></header>{text}<footer>Filed under news</footer></article></body>', f'<body><header>{menu}<main><h1>T</h1>{text}</main></header></body>',
    ):
        got = html_text.main_text(page)
        assert got.startswith("T\n\nSentence 0") and got.count("Sentence") == 4, (page, got)
        assert not any(x in got for x in ("Menu", "Name", "One", "Send", "typed", "rights", "Filed")), (page, got)
    assert "Site" not in html_text.main_text(f"<body><header><h1>Site</h1>{menu}</header><div><h1>T</h1>{text}</div></body>")
    assert html_text.main_text(f"<body><div hidden><main><h1>T</h1>{text}</main></div><p>Seen.</p></body>") == "Seen."
    assert html_text.main_text("<body><article><p>One <button>Copy</button>sentence only.</p><xmp><b>&amp;</b></xmp></article></body>") == "One sentence only.\n\n<b>&amp;</b>"


def test_html_is_read_in_time_proportional_to_its_length():
    import time

    for page in ("<p" * 200_000, "<" + "x" * 400_000, '<a ">' * 100_000, "<a b='>" * 100_000, "<noscript>" * 50_000, '<a b="' * 100_000, "<!--" * 100_000, "<li><b>" * 30_000, "<xmp>" * 50_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 10, page[:20]


def test_html_no_page_of_a_folder_is_emptied():
    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        page = html_text.Page(html)
        text = html_text.main_text(html)
        assert bool(text) == bool(page.blocks)
        assert all(block in [t for _, t in page.blocks] for block in text.split("\n\n"))


def test_html_names_alone_do_not_empty_a_page():
    text = "".join(f"<p>Sentence {k} of the article, which is long enough to count.</p>" for k in range(4))
    aside = '<div class="sidebar"><p>Side</p></div>'
    for page in (
        f'<body><div class="page has-sidebar"><h1>T</h1>{text}{aside}</div></body>', f'<body><h1>T</h1><div class="elementor-widget">{text}</div>{aside}</body>',
        f'<body><div id="header-menu-page"><article><h1>T</h1>{text}</article>{aside}</div></body>', f'<body><h1>T</h1><span class="form">{text}</span>{aside}</body>',
    ):
        got = html_text.main_text(page)
        assert got.startswith("T\n\nSentence 0") and got.count("Sentence") == 4 and "Side" not in got, page
    many = "<p>Nice, I agree with all that was said here!</p>" * 30
    assert "Nice" not in html_text.main_text(f'<body><div><h1>T</h1>{text}</div><div class="comments">{many}</div></body>')
    assert "Nice" not in html_text.main_text(f'<body><article><h1>T</h1>{text}</article><div class="widget">{many}</div></body>')


def test_html_offsets_and_inline_words():
    odd = "\u0130" * 40  # longer in lower case
    assert html_text.main_text(f"<p>{odd}</p><SCRIPT>var x = '<p>1</p>'</Script ><p>hello world second paragraph stays.</p>") == f"{odd}\n\nhello world second paragraph stays."
    got = html_text.main_text("<article><p>Let <math><mi>x</mi></math> be <svg><title>Icon</title><text>it</text></svg>. <object>Here</object> <button>Send</button></p></article>")
    assert got == "Let x be it. Here"


class Dom(html.parser.HTMLParser):
    """A page as nested [tag, attributes, children], built by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["#page", {}, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div", "article", "ul", "h1", "nav", "footer") and any(n[0] == "p" for n in self.open):
            self.handle_endtag("p")
        if tag == "li" and any(n[0] == "li" for n in self.open):
            self.handle_endtag("li")
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in ("br", "meta", "img"):
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def counts(node, dead=False, link=False):
    """(characters, link characters, tags, link tags) below a node."""
    total = [0, 0, 0, 0]
    for child in node[2]:
        if isinstance(child, str):
            got = (len(re.sub(r"[ \n]", "", child)), 0, 0, 0) if not dead else (0, 0, 0, 0)
            got = (got[0], got[0] if link else 0, 0, 0)
        elif child[0] in ("script", "style", "title"):
            continue
        else:
            noise = dead or child[0] in ("head", "nav", "footer") or child[1].get("class") == "ad"
            if child[0] in ("br", "meta", "img"):
                got = (0, 0, 0 if noise else 1, 0)
            else:
                c, lc, t, lt = counts(child, noise, link or child[0] == "a")
                got = (c, lc, t + 1, lt + (child[0] == "a"))
        total = [a + b for a, b in zip(total, got, strict=True)]
    return total


def every_node(node, dead=False, link=False):
    yield node, dead, link
    for child in node[2]:
        if not isinstance(child, str) and child[0] not in ("script", "style", "title", "br", "meta", "img"):
            yield from every_node(child, dead or child[0] in ("head", "nav", "footer") or child[1].get("class") == "ad", link or child[0] == "a")


def test_densities_equal_the_formula_on_another_dom():
    """Composite text density as published, node by node, on pages whose tree the standard library builds."""
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"select html from '{SF}/pages.parquet' where html is not null").fetchall()]
    for page in [*pages, PAGE.replace("<form>", "").replace("</form>", "").replace("<aside>Side</aside>", "").replace('<div class="comments"><p>Nice!</p></div>', "")]:
        dom = Dom(page)
        nodes = list(every_node(dom.root))
        body = next(n for n in nodes if n[0][0] == "body") if any(n[0][0] == "body" for n in nodes) else nodes[0]
        c_body, lc_body, _, _ = counts(*body)
        want = []
        for node in nodes:
            c, lc, t, lt = counts(*node)
            t, lt, plain = max(1, t), max(1, lt), max(1, c - lc)
            base = math.log(c / plain * lc + lc_body / max(1, c_body) * c + math.e)
            if c == 0:
                want.append((node[0][0], 0.0))
            elif base > 1 + 1e-9:
                want.append((node[0][0], c / t * max(0.0, math.log(c / max(1, lc) * t / lt, base))))
            else:
                want.append((node[0][0], c / t * math.log(c / max(1, lc) * t / lt + math.e - 1)))
        read = html_text.Page(page)
        got = list(zip(read.tag, html_text.densities(read), strict=True))
        assert [t for t, _ in got] == [t for t, _ in want] and np.allclose([d for _, d in got], [d for _, d in want])


@given(st.text("<>/ab =\"'&;!-", max_size=60))
@settings(max_examples=300, deadline=None)
def test_html_reads_any_markup(markup):
    text = html_text.main_text(markup)
    assert text == text.strip() and "\n\n\n" not in text


def test_html_edges(spark):
    for odd in (None, "", "<", "<p", "<!--", "<p>" * 3000, "<b>" * 30000, "x" * 200000, "<div '" * 2000, "<script>never closed"):
        html_text.main_text(odd)
    assert html_text.main_text("plain &lt; text") == "plain < text"
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None)], "page_id bigint, url string, html string, text string")
    got = html_text.extract_pages(pages).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [len(html_text.main_text(PAGE))] * 2 + [0] and html_text.extract_pages(pages.where("false")).count() == 0


# ---------------------------------------------------------------------- 2


def test_machine_learns_pairs_and_holds_out(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(1500):
        insult, group = rng.random() < 0.35, rng.random() < 0.35
        text = words(rng, 20) + ["insult"] * insult + ["group"] * group
        rng.shuffle(text)
        docs.append((k, " ".join(text)))
        labels.append((k, int(insult and group)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = toxicity.score_toxicity(d, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def machine_accuracy(texts, labels):
    """Accuracy on the last fifth of a machine trained on the rest."""
    terms, n = toxicity.Terms(), 4 * len(texts) // 5
    rows, y = [terms(t) for t in texts], np.array(labels, float)
    return ((toxicity.train(rows[:n], y[:n]).score(rows[n:]) >= 0.5) == y[n:]).mean()


def test_machine_learns_pairs_of_frequent_and_of_neutral_terms():
    rng = random.Random(11)
    texts, labels = [], []
    for _ in range(1500):  # each term is in 60 % of the texts
        insult, group = rng.random() < 0.6, rng.random() < 0.6
        texts.append(" ".join([*words(rng, 20), *["insult"] * insult, *["group"] * group]))
        labels.append(insult and group)
    assert machine_accuracy(texts, labels) > 0.97
    texts, labels = [], []
    for _ in range(1500):  # "insult" and "group" are as frequent in toxic texts as in clean ones
        toxic = rng.random() < 0.5
        texts.append(" ".join([*words(rng, 20), *rng.choice((["insult", "group"], ["slur"]) if toxic else (["insult"], ["group"]))]))
        labels.append(toxic)
    assert machine_accuracy(texts, labels) > 0.95


def test_machine_scores_by_its_formula():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, rng.normal(0, 0.5, 50).astype(np.float32), rng.normal(0, 0.3, (50, 4)).astype(np.float32))
    rows = [rng.choice(50, n, replace=False) for n in (0, 1, 2, 7, 20, 0)]
    for row, got in zip(rows, machine.score(rows), strict=True):
        z = machine.bias + sum(float(machine.w[i]) for i in row)
        z += sum(float(machine.v[i].astype(float) @ machine.v[j].astype(float)) for i, j in itertools.combinations(row, 2))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5


def test_contradicting_labels_and_the_bound_on_slots(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join([*words(rng, 15), *["bad"] * (k % 2)])) for k in range(400)], "doc_id bigint, text string")
    sure = [(k, k % 2) for k in range(400)]

    def scores(rows, **how):
        machine = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"), "doc_id", "text", "toxic", 1000, **how)
        return machine.score([toxicity.Terms()(t) for t in ("bad w1", "w1 w2")]).round(6).tolist()
    assert scores(sure) == scores([(k, 0) for k in range(400)] + sure) == scores(sure[::-1] * 2)
    assert scores(sure)[0] > 0.8 and scores(sure, max_slots=3000) != scores(sure) and scores(sure, max_slots=0)[0] < 1e-6


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0)], "doc_id bigint, toxic int")
    d = odd_documents(spark)
    assert toxicity.score_toxicity(d, labels).count() == d.count()
    assert toxicity.score_toxicity(d, labels.where("false")).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score_toxicity(empty_documents(spark), labels).count() == 0
    machine = toxicity.fit(d, labels, "doc_id", "text", "toxic", 100)
    assert toxicity.drop_toxic(d, machine).columns == d.columns
    named = d.withColumn("_toxic_score", F.lit("own")).withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id")))
    kept = toxicity.drop_toxic(named, machine)
    assert kept.columns == named.columns and {r["_toxic_score"] for r in kept.collect()} <= {"own"}
    assert {r["held_out"] for r in toxicity.score_toxicity(named, labels).where("doc_id is null").collect()} == {False}


# ---------------------------------------------------------------------- 3


def test_secrets_kept_and_removed(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    rows = [
        (1, 'config token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', True), (2, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff fixed", False), (3, "paid 4785380592391139 today", False),
        (4, "see id=550e8400-e29b-41d4-a716-446655440000 now", False), (5, "password: hT7+kQz91LmNp0sXyV3w", True),
    ]
    d = spark.createDataFrame([(k, t, None) for k, t, _ in rows], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(d, model, path_col="source").collect()}
    assert {k: got[k].kept for k, _, _ in rows} == {k: y for k, _, y in rows}
    assert all(rows[k - 1][1][r.start : r.end] == r.candidate for k, r in got.items())
    held = secrets.labelled_findings(spark, 800, seed=77)
    told = model.transform(secrets._described(held)).select((F.col("_y") == F.col("label")).cast("int").alias("ok"))
    assert told.agg(F.avg("ok")).first()[0] > 0.95
    assert secrets.scan(odd_documents(spark), model).count() == 0 and secrets.scan(empty_documents(spark), model).count() == 0


def test_secrets_in_values_and_urls(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    rows = [
        ('password = "Tr0ub4dor&3"', "Tr0ub4dor&3", True), ("export DB_PASS=hunter2secret9 now", "hunter2secret9", True), ("see postgres://user:pa55w0rd@host/db", "pa55w0rd", True),
        ("token: qzKvWmXrTbLpNc", "qzKvWmXrTbLpNc", True), ("pwd='aB3!x.Y&z$9q'", "aB3!x.Y&z$9q", True), ("a?password=fooQ12x45&token=barZ98y76", "fooQ12x45 barZ98y76", True),
        ("password: required", "required", False), ("token = ${API_TOKEN}", "${API_TOKEN", False), ("password = os.environ[PASSWORD]", "os.environ[PASSWORD", False),
    ]
    d = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id bigint, text string")
    got = secrets.scan(d, model).collect()
    assert sorted((r.doc_id, r.candidate) for r in got) == sorted((k, c) for k, (_, found, _) in enumerate(rows) for c in found.split())
    assert all(rows[r.doc_id][0][r.start : r.end] == r.candidate for r in got)
    assert [(r.candidate, r.score) for r in got if r.kept != rows[r.doc_id][2]] == []
    long = spark.createDataFrame([(1, "password=" + "aB!" * 200_000), (2, "token: " + "a1" * 200_000)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.end - r.start) for r in secrets.scan(long, model).collect()) == [(1, 600_000), (2, 400_000)]


# ---------------------------------------------------------------------- 4


def test_overlaps_tolerate_substitutions(spark):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, n, 5000))) for k, n in enumerate((40, 25, 18, 4, 60))]
    docs, want = [], set()
    for k in range(120):
        text = words(rng, rng.randint(0, 200), 5000)
        if k % 3 == 0:
            i = rng.randrange(len(items))
            part = items[i][1].split()
            if len(part) > 10:
                for at in range(4, len(part), 9):  # every ninth word replaced
                    part[at] = "changed"
            where = rng.randint(0, len(text))
            text[where:where] = part
            want.add((k, i))
        docs.append((k, ", ".join(text).upper()))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()} == want
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {k for k in range(120)} - {k for k, _ in want}


def qualifies(agree, least, share=0.8):
    return any(sum(agree[x:y]) >= share * (y - x) - 1e-9 for x in range(len(agree)) for y in range(x + least, len(agree) + 1))


def test_a_stretch_is_found_where_one_qualifies():
    share = decontaminate.Fraction("0.8")
    for n, least in ((8, 8), (13, 13), (15, 13), (18, 13)):
        for replaced in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(5)):
            agree = np.array([k not in replaced for k in range(n)])
            got = decontaminate.stretch(agree, least, share)
            assert (got is not None) == qualifies(agree.tolist(), least)
            assert got is None or (got[1] - got[0] >= least and agree[got[0] : got[1]].mean() >= 0.8 - 1e-9)


def test_masks_miss_no_placement():
    for n in range(decontaminate.LONGEST, 26):  # a longer stretch that qualifies holds one of these
        for replaced in itertools.combinations(range(n), n - (4 * n + 4) // 5):
            assert any(not any(k + o in replaced for o in mask) for mask in decontaminate.MASKS for k in range(n - mask[-1])), (n, replaced)


def test_overlaps_with_substitutions_at_every_position(spark):
    rng = random.Random(9)
    sizes = (6, 7, 8, 9, 10, 13, 15, 16)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in sizes]
    docs, want = [], set()
    for n, part in items:
        for replaced in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in (0, 1, 2, 3)):
            text = ["changed" if k in replaced else w for k, w in enumerate(part)]
            if qualifies([k not in replaced for k in range(n)], min(13, n)):
                want.add((len(docs), n))
            docs.append((len(docs), " ".join([*words(rng, 20), *text, *words(rng, 20)])))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(n, " ".join(part)) for n, part in items], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()} == want


def test_overlap_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (None, "word")], "item_id bigint, text string")
    got = decontaminate.overlaps(odd_documents(spark), items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(4, 3)]
    assert decontaminate.overlaps(empty_documents(spark), items).count() == 0 and decontaminate.overlaps(odd_documents(spark), items.where("false")).count() == 0
    kept = decontaminate.drop_contaminated(odd_documents(spark), items)
    assert kept.count() == odd_documents(spark).count() - 3 and kept.columns == odd_documents(spark).columns


# ---------------------------------------------------------------------- 5


@given(st.text(max_size=80) | st.text("ab é\n1!", max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(text):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, memo=50)
    ids = codec.encode(text)
    assert [int(x) for x in ids] == TIKTOKEN.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_piece_is_not_quadratic():
    piece = ("ab" * 20000).encode()
    assert bpe.merge_piece(piece, RANKS) == TIKTOKEN.encode_ordinary(piece.decode())


def test_bpe_rows(spark):
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.encode_decode(odd_documents(spark), VOCAB, public_tokenizers.PATTERN).collect())
    want = [(k, len(TIKTOKEN.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in enumerate(ODD)]
    assert got == sorted([*want, want[4], want[4]])
    assert bpe.encode_decode(empty_documents(spark), VOCAB, public_tokenizers.PATTERN, keep_ids=True).count() == 0


# ---------------------------------------------------------------------- 6


def test_shards_are_even_gapless_and_keep_copies(spark):
    rng = random.Random(6)
    texts = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(3000)]
    rows = [(k, texts[k % 2900] if k % 10 else "hot text") for k in range(4000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sharding.kd_shards(d, bucket_rows=50).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 4000 and set(sizes.index) == set(range(16)) and sizes.max() - sizes.min() < 0.04 * sizes.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    together = got.merge(d.toPandas()).groupby("text")["shard"].nunique()
    assert (together > 1).sum() <= 15
    uneven = sharding.kd_shards(d, shards=5).groupBy("shard").agg(F.sum("size")).collect()
    assert len(uneven) == 5


def one_process_tree(rows, shards):
    """The same tree over (size, dimensions) rows held in memory: the share of bytes of each leaf, and its dimensions' ranges."""
    whole = [max(r[1][k] for r in rows) - min(r[1][k] for r in rows) or 1.0 for k in range(len(rows[0][1]))]

    def split(part, s):
        if s == 1:
            return [part]
        widths = [(max(r[1][k] for r in part) - min(r[1][k] for r in part)) / whole[k] for k in range(len(whole))]
        k = widths.index(max(widths))
        part = sorted(part, key=lambda r: r[1][k])
        share, upto, cut = sum(r[0] for r in part) * (s // 2) / s, 0, 0
        while cut < len(part) and upto + part[cut][0] / 2 <= share:
            upto, cut = upto + part[cut][0], cut + 1
        return split(part[:cut], s // 2) + split(part[cut:], s - s // 2)

    return split(rows, shards)


@pytest.mark.parametrize("shards", [5, 16])
def test_shards_equal_a_tree_in_one_process(spark, shards):
    rng = random.Random(shards)
    rows = [(k, "x" * rng.randint(0, 40), rng.random() ** 2, rng.random() * 7) for k in range(1500)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, p double, q double")
    got = {r.doc_id: r.shard for r in sharding.kd_shards(d, shards=shards, dimensions=[F.col("p"), F.col("q")], tolerance=1e-9).collect()}
    want = one_process_tree([(len(t) + 1, (p, q), k) for k, t, p, q in rows], shards)
    place = {r[2]: n for n, part in enumerate(want) for r in part}
    # A cell of the distributed median is 1/65,535 of a node's range: rows in the cell of a cut are told apart by hash.
    assert sum(got[k] != place[k] for k in place) <= 0.01 * len(place)


def test_default_dimensions_are_shared_by_copies(spark):
    texts = [None, "", "a b\nc", "\u00e9\u00e9", " " * 9]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = d.select(*sharding.text_dimensions(F.col("text"))).collect()
    assert list(got[0]) == [None] * 4 and list(got[1]) == [0.0, 0.0, 0.0, 0.0]
    assert [round(v, 6) for v in got[2]] == [round(math.log2(6), 6), 1.0, round(math.log2(5 / 2 + 1), 6), 1.0] and got[3][1] == 2.0


def test_shard_edges(spark):
    d = odd_documents(spark)
    got = sharding.kd_shards(d)
    assert got.count() == d.count() and got.where("doc_id = 0").first().text_crc32 is None and sharding.kd_shards(empty_documents(spark)).count() == 0
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"))
    sizes = [r[1] for r in sharding.kd_shards(same).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 4


# ---------------------------------------------------------------------- 7


def brute_components(rows):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("group_rows", [20_000, 4])
def test_components_equal_brute_force(spark, group_rows):
    rng = random.Random(7)
    passage, rows = words(rng, 40), []
    bases = [words(rng, rng.randint(3, 80)) for _ in range(12)]
    for k in range(260):
        text = list(rng.choice(bases)) if rng.random() < 0.8 else words(rng, rng.randint(0, 60))
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            if text:
                text[rng.randrange(len(text))] = f"w{rng.randrange(400)}"
        if rng.random() < 0.3:
            text = text[: rng.randint(0, 30)] + passage
        rows.append((k, " ".join(text)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(d, group_rows=group_rows).collect()}
    assert got == brute_components(rows)


def test_component_edges(spark):
    d = odd_documents(spark)
    got = defaultdict(set)
    for r in ngram_join.ngram_components(d).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert {k: v.pop() for k, v in got.items()} == brute_components(list(enumerate(ODD)))
    assert ngram_join.ngram_components(empty_documents(spark)).count() == 0
    kept = ngram_join.keep_one(d)
    assert sorted(r.doc_id for r in kept.select("doc_id").distinct().collect()) == list(range(10)) and kept.columns == d.columns


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=6, deadline=None)
def test_connected_components(spark, pairs):
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).df.collect()
    assert {r.node: r.root for r in got} == root


def test_suffix_filter_and_signature_never_reject_links():
    rng = np.random.default_rng(8)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.15], rng.integers(0, 1 << 62, rng.integers(0, 12), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert ngram_join.links(x, y, 75) == (100 * both >= 75 * (len(x) + len(y) - both))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(ngram_join.signature(x).view(np.uint64), ngram_join.signature(y).view(np.uint64), strict=True))
        assert bits <= len(x) + len(y) - 2 * both


def test_words_split_like_bytes_split():
    split = Splitter(b" \t\n\x0b\x0c\r")
    for text in (b"", b"  ", b"a", b" One two\tONE \n two ", ("é ü " * 200000).encode(), b"x" * (PIECE + 5000) + b" y"):
        hashes, want = split(text), text.lower().split()
        assert len(hashes) == len(want)
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(want, hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------------- 8


def plain_base(text):
    """The base patterns as they are written, for short texts."""
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@given(st.text("0123456789.@+-() ab%", max_size=60) | st.from_regex(r"[0-9]{11,20}|\+[0-9 ().-]{8,18}[0-9]|[a-c.]{1,5}@[a-c]{1,4}(\.[a-c]{1,3}){0,2}", fullmatch=True))
@settings(max_examples=800, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_model_finds_spans_on_held_out_lines():
    model, rng, right = pii.train(), random.Random(12345), 0
    for _ in range(400):
        text, gold = pii.labelled_line(rng)
        base, spans = pii.find_spans(text, model)
        assert set(base) <= set(spans)
        right += [s for s in gold if not any(b[0] < s[1] and s[0] < b[1] for b in base)] == [s for s in spans if s not in base]
    assert right / 400 > 0.9


#: Lines written by hand, with their spans; no generated line has their words, and nothing was chosen by them.
PLAIN_LINES = [
    ("If lost, please phone 0161 496 0821.",[("0161 496 0821","phone")]),
    ("Sie erreichen uns unter Telefon 089 5550123",[("089 5550123","phone")]),
    ("Notre fax: 04 76 55 01 22",[("04 76 55 01 22","phone")]),
    ("movil 612 34 56 78",[("612 34 56 78","phone")]),
    ("dial 303-555-0147 for help",[("303-555-0147","phone")]),
    ("Her cell is (702) 555 0166",[("(702) 555 0166","phone")]),
    ("Text me at 07911 123456",[("07911 123456","phone")]),
    ("Handy 0171/2345678",[("0171/2345678","phone")]),
    ("ping tom.hardy at corp dot io",[("tom.hardy at corp dot io","email")]),
    ("press [at] museum [dot] nl",[("press [at] museum [dot] nl","email")]),
    ("mail: info (at) laden (dot) de",[("info (at) laden (dot) de","email")]),
    ("lucia @ correo . es",[("lucia @ correo . es","email")]),
    ("send it to max_muster AT post DOT ch today",[("max_muster AT post DOT ch","email")]),
    ("gateway address 172 . 16 . 254 . 1",[("172 . 16 . 254 . 1","ip")]),
    ("node 8 . 8 . 4 . 4 replied",[("8 . 8 . 4 . 4","ip")]),
    ("his credit card 4012.8888.8888.1881",[("4012.8888.8888.1881","card")]),
    ("She arrived at seven dot on the minute",[]),
    ("Meet me at gate 12. Com links are below",[]),
    ("batch 0442 119821 passed inspection",[]),
    ("ISBN 978-0-306-40615-7",[]),
    ("the years 1914 1918 1939 1945",[]),
    ("latitude 48.8583701 longitude 2.2944813",[]),
    ("ratio 3 . 14 is not an address",[]),
    ("budget of 250 000 000 euros",[]),
    ("invoice 2023/0004567 is due",[]),
    ("timestamp 1700000000 was logged",[]),
    ("they stayed at home. org charts follow",[]),
    ("patent US 7654321 B2",[]),
]


def test_model_on_lines_written_by_hand():
    model, found, extra, every = pii.train(), 0, 0, 0
    for text, gold in PLAIN_LINES:
        spans = {(text.index(s), text.index(s) + len(s), kind) for s, kind in gold}
        got = set(pii.find_spans(text, model)[1])
        found, extra, every = found + len(got & spans), extra + len(got - spans), every + len(spans)
    assert (every, extra) == (16, 0) and found >= 14  # the two missed are phone numbers after words without a cue


def test_best_segmentation_equals_enumeration():
    model = pii.train()
    text = "tel (555) 123-4567 x"
    w = pii.Window(text, 0, len(text))
    ends = model.segments(w)

    def every(j):
        if j == 0:
            yield 0.0, "O"
            return
        for i, kind, s in ends[j]:
            for total, prior in every(i):
                yield total + s + model.weights.get((prior, f">{kind}"), 0.0), kind

    best, at, prior, total = max(x for x, _ in every(len(w.tokens))), 0, "O", 0.0
    spans = {i: (j, k) for i, j, k in model.decode(w)}
    while at < len(w.tokens):
        j, kind = spans.get(at, (at + 1, "O"))
        total += next(s for i, k, s in ends[j] if (i, k) == (at, kind)) + model.weights.get((prior, f">{kind}"), 0.0)
        at, prior = j, kind
    assert abs(best - total) < 1e-9


def test_pii_rows(spark):
    got = {r.doc_id: r for r in pii.detect(odd_documents(spark)).collect()}
    assert (got[8].n_phone, got[8].n_email, got[8].n_ip, got[8].n_card) == (1, 1, 1, 0) and got[0].spans == ""
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.mask(odd_documents(spark))
    assert masked.where("doc_id = 8").first().text == "<phone> <email> <ip>" and masked.where("doc_id = 0").first().text is None and masked.columns == odd_documents(spark).columns
    assert pii.detect(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 50, 1024])
def test_pieces_of_a_window_are_decoded_like_the_whole(monkeypatch, piece):
    monkeypatch.setattr(pii, "PIECE_TOKENS", piece)
    rng, model = random.Random(piece), pii.train()
    for n in (0, 1, 2, 30):
        for _ in range(4):
            text = rng.choice([" ", "  ", "\n"]).join(pii.labelled_line(rng)[0] for _ in range(n))
            w = pii.Window(text, 0, len(text))
            whole = [(w.spans[i][0], w.spans[j - 1][1], kind) for i, j, kind in model.decode(w)]
            assert list(model.decode_text(text, 0, len(text))) == whole
    # A segmentation that the last token alone decides stays open to the end.
    for text in ("5550100 " * 300, "0 1 2 3 4 5 6 7 8 9 " * 200, "a at b dot com " * 200):
        w = pii.Window(text, 0, len(text))
        assert list(model.decode_text(text, 0, len(text))) == [(w.spans[i][0], w.spans[j - 1][1], kind) for i, j, kind in model.decode(w)]


def test_a_long_text_of_numbers_takes_bounded_memory():
    import tracemalloc

    model, peaks = pii.train(), []
    for n in (1500, 6000):
        text = " ".join(f"555 {k:07d}" for k in range(n))
        tracemalloc.start()
        pii.find_spans(text, model)
        peaks.append(tracemalloc.get_traced_memory()[1] - len(text) * 4)
        tracemalloc.stop()
    assert peaks[1] < 1.6 * peaks[0] and peaks[1] < 60e6


def test_base_and_added_spans_never_touch():
    rng, model = random.Random(12), pii.train()
    for _ in range(30):
        text = " ".join(rng.choice([pii.labelled_line(rng)[0], "+1 (743) 555-3824", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "x 12 y"]) for _ in range(25))
        base, every = pii.find_spans(text, model)
        added = [s for s in every if s not in base]
        assert not any(p < y and x < q for x, y, _ in added for p, q, _ in base)


# ---------------------------------------------------------------------- 9


@pytest.mark.parametrize(("block_rows", "query_rows"), [(8192, 1024), (40, 3)])
def test_top_k_equals_brute_force(spark, block_rows, query_rows):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 12)).round(2)
    x[100:140] = x[7]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(600, None), (700, [1.0, None] + [0.0] * 10), (800, [float("nan")] * 12), (900, [1.0, 2.0]), (1000, [])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.exact_top_k(d, F.col("vec_id") % 100 == 0, block_rows=block_rows, query_rows=query_rows).orderBy("query_id", "rank").collect()
    whole = np.floor(x * 1024).astype(np.int64)
    want = []
    for q in range(0, 500, 100):
        order = sorted((k for k in range(500) if k != q), key=lambda k: (-int(whole[k] @ whole[q]), k))[:10]
        want += [(q, r, k, int(whole[k] @ whole[q])) for r, k in enumerate(order, 1)]
    assert [tuple(r) for r in got] == want
    assert topk.exact_top_k(d.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (4000, 8)), rng.integers(400, 500, (30, 8))])
    lists = topk.SortedLists(np.arange(len(x)), x)
    ids, scores = lists.top(np.ones(8), -1, 10)
    best = np.lexsort((np.arange(len(x)), -x.sum(1)))[:10]
    assert ids.tolist() == best.tolist() and scores.tolist() == x.sum(1)[best].tolist()
    assert 30 <= lists.read <= 2 * len(x) // topk.READS  # the thirty lead every list
    for floor in (None, int(np.sort(x.sum(1))[-60])):
        for query in (rng.integers(-3, 4, 8), np.array([0, 0, 1, 0, 0, -1, 0, 0]), np.zeros(8, int)):
            ids, scores = lists.top(query, 17, 10, topk.LEAST if floor is None else floor)
            whole = x @ query
            want = [k for k in np.lexsort((np.arange(len(x)), -whole)) if k != 17 and (floor is None or whole[k] >= floor)][:10]
            assert ids.tolist() == want and scores.tolist() == whole[want].tolist()


def test_lists_of_every_block_are_read():
    """Blocks of any size over k, values beyond doubles, and all vectors of the smallest folders."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    for m, span in ((12, 100), (500, 100), (500, 1 << 30), (2000, 1 << 30), (700, 1 << 52)):
        x = rng.integers(-span, span, (m, 8)).astype(np.float64)
        lists = topk.SortedLists(np.arange(m), x)
        for _ in range(5):
            query = rng.integers(-span, span, 8)
            ids, scores = lists.top(query, 3, 10)
            whole = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in x]
            want = sorted((k for k in range(m) if k != 3), key=lambda k: (-min(max(whole[k], topk.LEAST), topk.MOST), k))[:10]
            assert ids.tolist() == want and scores.tolist() == [min(max(whole[k], topk.LEAST), topk.MOST) for k in want]
            assert lists.read > 0
    rows = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").sort_by("vec_id")
    x = np.floor(1024 * np.stack(rows["embedding"].to_numpy()).astype(np.float64))
    ids = rows["vec_id"].to_numpy()
    lists = topk.SortedLists(ids, x)
    for k in np.flatnonzero(ids % 100 == 0):
        got, _ = lists.top(x[k], ids[k], 10)
        order = np.lexsort((ids, -(x @ x[k])))
        assert got.tolist() == [int(i) for i in ids[order] if i != ids[k]][:10] and lists.read > 0


def test_blocks_that_cannot_reach_are_not_read(spark):
    rng = np.random.default_rng(4)
    near = rng.integers(900, 1000, (50, 6)) * [1, 0, 0, 0, 0, 0] + rng.integers(0, 3, (50, 6))
    far = rng.integers(900, 1000, (50, 6)) * [0, 1, 0, 0, 0, 0] + rng.integers(0, 3, (50, 6))
    d = spark.createDataFrame([(k, v.tolist(), k % 100 == 0) for k, v in enumerate(np.concatenate([near, far]).astype(float))], "id bigint, x array<double>, q boolean")
    rows = topk._blocks(d, 50).cache()
    assert rows.select("block").distinct().count() == 2
    asked = rows.where("q").select("id", "x", F.col("block").alias("home"), F.lit(100_000).cast("bigint").alias("floor"))
    assert topk._other_blocks(asked, rows, 1).count() == 0
    assert topk._other_blocks(asked.withColumn("floor", F.lit(1_000).cast("bigint")), rows, 1).count() == asked.count() == 1


def test_top_k_of_huge_values_repeats_and_one_identifier(spark):
    def top(rows):
        d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        return [tuple(r) for r in topk.exact_top_k(d, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]

    huge = [(100, [1e12, 1.0]), (1, [1e12, 2.0]), (2, [-1e12, 2.0]), (3, [0.0, 5.0]), (4, [1.7e308, 0.0])]
    assert top(huge) == [(100, 1, 1, topk.MOST), (100, 2, 4, topk.MOST), (100, 3, 3, 5 * 1024 * 1024), (100, 4, 2, topk.LEAST)]
    one = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [3.0, 0.0]), (7, [2.0, 5.0]), (7, [3.0, 0.0])]
    assert top(one) == [(100, 1, 7, 5 << 20), (100, 2, 7, 0), (100, 3, 7, 0)]  # the least vector asks, repeats count each
    assert top([(0, [1.0])] * 3) == [] and top([(None, [1.0]), (0, [1.0])]) == []


# --------------------------------------------------------------------- 10


def test_calls_are_linked_checked_and_ordered(spark):
    def call(i, name, arguments, after="[]"):
        return f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{arguments},"after":{after}}}</tool_call>'

    turns = [
        (1, 0, "system", "be \"good\""), (1, 1, "assistant", call("a", "find", '{"n": 2, "q": "x"}') + call("b", "find", '{"q": 5}', '["c"]')), (1, 2, "assistant", call("c", "find", '{"q": "y", "z": 1}') + call("d", "nope", "{}")),
        (1, 3, "tool", '{"tool_call_id":"a","content":"first"}'), (1, 4, "tool", '{"tool_call_id":"a","content":"again"}'), (1, 5, "tool", '{"tool_call_id":"lost","content":null}'),
        (2, 1, "assistant", call("p", "find", '{"q":"1"}', '["r"]') + call("r", "find", '{"q":"2"}', '["p"]')), (None, None, "user", None),
    ]
    d = spark.createDataFrame([(*r, "c") for r in turns], "conv_id bigint, turn bigint, role string, text string, position string")
    schemas = chat.schema_table(spark, {"find": {"q": ("string", True), "n": ("integer", False)}, "reply": {"text": ("string", True), "turn": ("integer", True)}})
    rows = chat.format_chats(d, schemas).orderBy("conv_id", "position").collect()
    got = {r.call_id: r for r in rows if r.conv_id == 1 and r.record.endswith("call")}
    assert got["a"].record == "call" and got["a"].errors == "" and got["a"].json == '{"arguments":{"n":2,"q":"x"},"id":"a","name":"find","type":"call"}'
    assert got["b"].errors == "type:q" and got["c"].errors == "unknown:z" and got["d"].errors == "tool"
    assert got["c"].position < got["b"].position and got["b"].record == "open_call" and not got["b"].cyclic
    results = sorted((r.turn, r.record) for r in rows if r.conv_id == 1 and r.record.endswith("result"))
    assert results == [(3, "result"), (4, "extra_result"), (5, "orphan_result")]
    assert {r.call_id for r in rows if r.cyclic} == {"p", "r"}
    for c in (1, 2, None):
        mine = [r.position for r in rows if r.conv_id == c]
        assert sorted(mine) == list(range(len(mine)))
    assert chat.format_chats(d.where("false"), schemas).count() == 0


def places_by_hand(turns, waits):
    """(turn, steps) and whether on or behind a cycle, for each call, by going through all paths."""
    n = len(turns)
    out = {}
    for c in turns:
        layer, best, steps = {c}, (turns[c], 0), 0
        while layer and steps <= n:
            steps += 1
            layer = {u for x in layer for u in waits.get(x, ()) if u in turns}
            best = max([best, *((turns[u], steps) for u in layer)])
        out[c] = ((turns[c], 0), True) if layer else (best, False)
    return out


def test_places_equal_all_paths(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for conv in range(40):
        n = rng.choice((1, 3, 8, 20))
        turns = {f"k{k}": rng.randrange(30) for k in range(n)}
        kind = conv % 4
        if kind == 0:  # a chain in which each waits for the next
            waits = {f"k{k}": [f"k{k + 1}"] for k in range(n)}
        elif kind == 1:  # one ring, and calls behind it
            waits = {f"k{k}": [f"k{(k + 1) % max(1, n // 2)}"] for k in range(n)}
        elif kind == 2:  # several waits forwards, no cycle
            waits = {f"k{k}": [f"k{rng.randrange(k + 1, n + 1)}" for _ in range(3)] for k in range(n)}
        else:
            waits = {f"k{k}": [f"k{rng.randrange(n)}" for _ in range(rng.choice((0, 0, 1, 2)))] for k in range(n)}
        want |= {(conv, c): v for c, v in places_by_hand(turns, waits).items()}
        rows += [(None if conv == 3 else conv, turns[c], f"<tool_call>{json.dumps({'id': c, 'name': 'x', 'arguments': {}, 'after': waits[c]})}</tool_call>") for c in turns]
    d = spark.createDataFrame([(c, t, "assistant", text) for c, t, text in rows], "conv_id bigint, turn bigint, role string, text string")
    placed = chat._places(chat.embedded_calls(chat.read_turns(d))).collect()
    assert {(3 if r.no_conv else r.conv_id, r.call_id): (tuple(r.place), r.cyclic) for r in placed} == want


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    made = []
    monkeypatch.setattr(chat, "store", lambda df, name: made.append(name) or store(df, name))
    calls = [(1, k, "assistant", f'<tool_call>{{"id":"k{k}","name":"x","arguments":{{}},"after":["k{k + 1 if k < 299 else 299}"]}}</tool_call>') for k in range(300)]
    for rows, cyclic in ((calls[:299], 0), (calls, 300)):
        made.clear()
        d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        got = chat._places(chat.embedded_calls(chat.read_turns(d))).collect()
        assert sum(r.cyclic for r in got) == cyclic and made.count("seen") <= 11
        assert cyclic or {(r.turn, tuple(r.place)) for r in got} == {(k, (298, 298 - k)) for k in range(299)}


def test_chat_edges(spark):
    def turn(conv, turn, role, text):
        return (conv, turn, role, text, "clash", 1)

    ask = '<tool_call>{"id":"a","name":"find","arguments":{"q":"x"}}</tool_call>'
    long = json.dumps({"tool_call_id": "a", "content": "y" * 3_000_000})
    rows = [turn(c, t, r, x) for c in (None, 5) for t, r, x in ((1, "assistant", ask), (1, "assistant", ask), (2, "tool", long), (2, "tool", long), (None, "user", "no turn"), (3, None, None))]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, position string, no_conv int")
    schemas = chat.schema_table(spark, {"find": {"q": ("string", True)}})
    got = chat.format_chats(d, schemas).collect()
    for conv in (None, 5):
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.record for r in mine] == ["message", "message", "message", "call", "call", *sorted(["extra_result", "result"]), "message"]
        assert [r.position for r in mine] == list(range(8)) and mine[0].turn is None and max(len(r.json) for r in mine) > 3_000_000


# --------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert 0.5 * before < docs.count() < before
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_queries_with_sql_equal_it(spark):
    import duckdb

    from docloom.llm import queries

    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = c.execute(sql).df()
        got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
        assert sorted(map(str, got.astype(str).to_numpy().tolist())) == sorted(map(str, want.astype(str).to_numpy().tolist()))


def test_tool_turns_of_other_forms_keep_their_text(spark):
    texts = ["plain output", '{"tool_call_id": "a", "content": "cut', '{"tool_call_id": "a", "output": "x"}', '{"content": "y"}', "[1]"]
    rows = [(1, k, "tool", t) for k, t in enumerate([*texts, '{"tool_call_id": "a", "content": "z"}'])]
    d = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = {r.turn: (r.call_id, r.content) for r in chat.embedded_results(chat.read_turns(d)).collect()}
    assert [got[k][1] for k in range(6)] == [*texts, "z"] and got[5][0] == "a"


def test_prefix_rows_unpack_as_they_were():
    rng = np.random.default_rng(3)
    group, key = rng.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2), rng.integers(-(1 << 63), 1 << 63 - 1, 50)
    part, size, pos = rng.integers(0, 1 << 22, 50), rng.integers(1, 1 << 31, 50), rng.integers(0, 1 << 31, 50)
    got = ngram_join.unpack_rows(ngram_join.pack_rows(group, key, part, size << ngram_join.POS_BITS | pos))
    order = np.argsort(group)
    assert [x.tolist() for x in got[:3]] == [x[order].tolist() for x in (group, key, part)]
    assert (got[3] >> 32).tolist() == size[order].tolist() and (got[3] & (1 << 32) - 1).tolist() == pos[order].tolist()


def test_the_rest_meets_in_blocks(spark):
    """Pairs of different components of one n-gram that many rows share, whichever parts they are dealt to."""
    rng = random.Random(12)
    rows = [(1, rng.randrange(1, 5), k, rng.randrange(20, 60), rng.randrange(0, 4), k % 9, 0, 0, 0, 0, 3, 5) for k in range(80)]
    d = spark.createDataFrame(rows, "gram bigint, part int, key bigint, size int, pos int, root bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, largest bigint, last int")
    for percent in (75, 60, 100):
        want = set()
        for x, y in itertools.product(rows, rows):
            alike = 100 * min(x[3], y[3]) >= percent * max(x[3], y[3]) and (100 + percent) * min(x[3] - x[4], y[3] - y[4]) >= percent * (x[3] + y[3])
            if x[5] != 3 and x[5] != y[5] and alike:
                want.add((min(x[2], y[2]), max(x[2], y[2])))
        got = ngram_join._rest(d, percent).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_prefix_rows_write_no_more_of_a_hash_than_tells_ngrams_apart():
    """Low bits of all groups are alike, so they pack to nothing; parts of an n-gram stay apart and lead back to it."""
    rng = np.random.default_rng(5)
    s = rng.integers(0, 1 << 63, 3000, np.int64).view(np.uint64)
    part = rng.integers(0, 4, len(s))
    parts = np.where(part > 0, 3, 1)
    grams = ngram_join.grams_of(s, parts)
    group = grams ^ ngram_join.group_step(part)
    assert (group & np.uint64(0xFFFF) == 0).all() and (group ^ ngram_join.group_step(part) == grams).all()
    assert len(np.unique(ngram_join.group_step(np.arange(100_000)))) == 100_000
    assert ((grams ^ s) >> np.uint64(17) == 0).all() and ((grams & np.uint64(ngram_join.DEALT) > 0) == (part > 0)).all()
    key, where = rng.integers(0, 9, len(s)), np.full(len(s), 5)
    sizes = [len(ngram_join.pack_rows(g, key, part, where)) for g in (s, group)]
    assert sizes[1] < sizes[0] - 1.5 * len(s)
