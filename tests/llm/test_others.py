import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontamination as D
from leafmill.llm import html_text as H
from leafmill.llm import language, licences, quality, warc, words

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# -- decontamination --


def test_word_hashes(documents):
    for table, pattern in ((words.SPACED, SPACE), (words.LETTERS, licences.WORD)):
        seen, names = {}, {}
        for r in documents.collect():
            text = r.text + " \x1c中文,x\x85y"
            found = pattern.findall(text.translate(licences.UPPER))
            got = words.word_hashes(text, table).tolist()
            assert len(found) == len(got)
            for w, h in zip(found, got, strict=True):
                assert seen.setdefault(w, h) == h and names.setdefault(h, w) == w


def test_wand():
    random.seed(3)
    base = [[random.choice("abcdefghij") for _ in range(random.randint(1, 30))] for _ in range(60)]
    index = D.Index([(i, " ".join(b)) for i, b in enumerate(base)])
    for _ in range(300):
        query = sorted(random.sample(range(len(index.terms)), random.randint(1, min(200, len(index.terms)))))
        score = Counter()
        for t in query:
            for k, v in zip(*index.postings[t], strict=True):
                score[int(k)] += v
        assert sorted((k, round(v, 9)) for k, v in score.items() if v >= 1 - 1e-9) == sorted((k, round(v, 9)) for k, v in index.retrieve(query))


def test_templates():
    """Items that share most of their words are found all at once, and not where only some of the template stands."""
    import time

    rng = random.Random(1)
    own = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    template = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join([*template[:30], *own(8), *template[30:]])) for i in range(4000)]
    index = D.Index(rows)
    whole, some = " ".join([*rows[7][1].split(), *own(100)]), " ".join([*template[:12], *own(138)])
    began = time.process_time()
    found, none = index.search(whole), index.search(some)
    assert time.process_time() - began < 1
    parts = lambda text: {tuple(x) for w in [text.split()] for x in zip(*(w[i:] for i in range(5)), strict=False)}
    held = parts(whole)
    want = [i for i, text in rows if len(parts(text) & held) >= 0.75 * len(parts(text))]
    assert [f[0] for f in found if f[4] >= 0.75] == want and none == [] and dict((f[0], f[4]) for f in found)[7] == 1.0


def test_leaks(spark, sf, documents, edge_docs, no_docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents, items).collect()}
    parts = lambda t: {tuple(w[i : i + 5]) for w in [licences.WORD.findall(t.translate(licences.UPPER))] for i in range(len(w) - 4)}
    sets = {r.item_id: parts(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in documents.collect() for g in [parts(r.text)] for i, s in sets.items() if len(s & g) >= 0.75 * len(s)}
    assert want and got == want
    for a, b in ((edge_docs, items), (no_docs, items), (documents, items.limit(0)), (documents, spark.createDataFrame([(1, None), (None, ""), (2, " .")], "item_id long, text string"))):
        assert D.find_leaks(a, b).count() == 0


def test_partial_leaks(spark, monkeypatch):
    random.seed(9)
    item = [f"w{i}" for i in range(40)]
    filler = lambda n: [f"f{random.randint(0, 9999)}" for _ in range(n)]
    docs = [
        (1, filler(300) + item + filler(100)), (2, filler(10) + [w.upper() + "," for w in item]), (3, item[:33]), (4, item[:20] + filler(3000)),
        (5, item[:18] + ["edit"] + item[19:]), (6, filler(500)), (7, random.sample(item, 40)),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, "Short one?\nAnswer: yes indeed")], "item_id long, text string")
    assert {r.doc_id for r in D.find_leaks(docs, items).collect()} == {1, 2, 3, 5}
    monkeypatch.setattr(D, "INDEX_BYTES", 50)  # several indexes find the same
    assert {r.doc_id for r in D.find_leaks(docs, items).collect()} == {1, 2, 3, 5}
    assert D.split_item("A b? C d.") == ("A b?", "C d.") and D.split_item("Q?\nAnswer: 4") == ("Q?", "4") and D.split_item("a b c d") == ("a b c", "d")


def test_leaks_by_brute_force(spark):
    """Question and answer branch as well: items, and texts that hold parts of them, at random."""
    random.seed(13)
    vocabulary = [f"v{i}" for i in range(400)]
    words_of = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = []
    for i in range(60):
        q, a = words_of(random.randint(3, 40)), words_of(random.randint(1, 12))
        items.append((i, " ".join(q) + "?\nAnswer: " + " ".join(a)))
    docs = []
    for d in range(150):
        parts = [words_of(random.randint(0, 30))]
        for i in random.sample(range(60), 2):
            q, a = (licences.WORD.findall(x) for x in D.split_item(items[i][1]))
            for x in (q, a) if random.random() < 0.5 else (a, q):
                lo = random.randint(0, max(0, len(x) // 4))
                parts += [x[lo : len(x) - random.randint(0, max(0, len(x) // 8))], words_of(random.randint(0, 6))]
        docs.append((d, " ".join(w for p in parts for w in p)[:1200]))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    parts = {i: [runs(licences.WORD.findall(x)) for x in (item, *D.split_item(item))] for i, item in items}
    want = set()
    for d, text in docs:
        found = licences.WORD.findall(text)
        for at in range(0, max(1, len(found)), 64):
            passage = found[at : at + 128 + 5]
            there = {tuple(passage[i : i + k]) for k in range(1, 6) for i in range(len(passage) - k + 1)}
            for i, three in parts.items():
                whole, q, a = (len(x & there) / len(x) for x in three)
                if whole >= 0.75 or q >= 0.75 and a >= 0.75:
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want and got == want


def test_index_size():
    """Bytes of an index, and those that building it takes, for each byte of text: at the bound, under 300 MB on the driver."""
    import pickle
    import tracemalloc

    random.seed(2)
    rows, size = [], 0
    while size < D.INDEX_BYTES // 8:
        text = " ".join(f"w{random.randint(0, 30_000)}" for _ in range(random.randint(8, 90)))
        rows.append((len(rows), text))
        size += len(text)
    tracemalloc.start()
    index = D.Index(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.nbytes - len(index.bits) < D.ARRAYS * size and 8 * peak < 300 << 20 and len(pickle.dumps(index)) < 1.1 * index.nbytes + (4 << 20)
    assert [i for i, *_ in index.search("x " * 50 + rows[77][1] + " y" * 50)] == [77]


# -- licences --


def test_expressions():
    rpn = licences.parse_expression("mit or (apache-2.0 with llvm-exception and bsd)")
    assert rpn == ["mit", "apache-2.0", "llvm-exception", "with", "bsd", "and", "or"]
    assert licences.licences_of(rpn) == ["mit", "apache-2.0", "bsd"] and licences.evaluate(rpn) == "permissive"
    for bad in ("", "mit or", "(mit", "mit)", "or mit", "mit apache", "()"):
        assert licences.parse_expression(bad) is None
    tag = "spdx-license-identifier: "
    for text, want in (("mit or gpl-2.0 */ x", ["mit", "gpl-2.0", "or"]), ("(mit) or (x", ["mit"]), ("mit with", ["mit"]), ("mit.", ["mit"]), ("see the file", ["see"]), (") mit", None)):
        assert licences.tag_expression(tag + text, len(tag)) == want
    for text, asks in (("gpl-2.0-only with classpath-exception-2.0", "weak-copyleft"), ("gpl-3.0-or-later or mit", "permissive"), ("agpl-3.0 and mit", "network-copyleft"), ("see or mit", "permissive"), ("see and mit", None), ("licenseref-x", "restricted"), ("cc-by-nc-4.0", "restricted")):
        assert licences.evaluate(licences.parse_expression(text)) == asks


def _descend(tokens):
    """An independent reading of an expression: precedence climbing over the tokens, evaluated as it goes."""

    def level(n):
        if n == 3:
            t = tokens.pop(0)
            if t == "(":
                v = level(0)
                assert tokens.pop(0) == ")"
                return v
            kind = licences.kind_of(t)
            return {t}, None if kind is None else licences.KINDS_OF.index(kind)
        names, v = level(n + 1)
        while tokens and tokens[0] == ("or", "and", "with")[n]:
            tokens.pop(0)
            more, w = level(n + 1)
            if n == 2:
                v = v if v is None or v > 3 else min(v, 2)
            else:
                names, v = names | more, (v if w is None else w if v is None else min(v, w)) if n == 0 else None if v is None or w is None else max(v, w)
        return names, v

    return level(0)


def test_random_expressions():
    random.seed(4)
    some = ["mit", "apache-2.0", "gpl-2.0+", "lgpl-2.1-only", "agpl-3.0", "busl-1.1", "cc0-1.0", "nothing", "licenseref-a"]

    def make(depth):
        kind = random.random()
        if not depth or kind < 0.3:
            return random.choice(some) + random.choice(["", "", " with llvm-exception"])
        x = f"{make(depth - 1)} {random.choice(['and', 'or'])} {make(depth - 1)}"
        return f"({x})" if kind < 0.7 else x

    scanner = licences.Scanner()
    for _ in range(300):
        text = make(random.randint(0, 5))
        names, value = _descend(licences.TOKEN.findall(text))
        rpn = licences.parse_expression(text)
        assert licences.evaluate(rpn) == (None if value is None else licences.KINDS_OF[value])
        known = sorted({n for n in names if licences.kind_of(n)})
        row = scanner.scan(f"# SPDX-License-Identifier: {text.upper()}\nprose")
        assert row[5] == ",".join(known) and row[7] == ([" ".join(rpn)] if known else [])


def test_long_expression():
    names = [f"gpl-{i}.{j}" for i in range(20) for j in range(10)]
    row = licences.Scanner().scan("SPDX-License-Identifier: " + " or ".join(names) + " see the file\n" + "(" * 100_000)
    assert row[5].split(",") == sorted(names) and row[8] == "copyleft"
    row = licences.Scanner().scan("SPDX-License-Identifier: " + "(" * 50_000 + "mit" + ")" * 50_000)
    assert row[5] == "mit"
    row = licences.Scanner().scan("SPDX-License-Identifier: see the file. License-Expression: the thing")
    assert row[5:] == ("", 0.0, [], None)


def test_labels_by_brute_force(documents):
    for r in documents.collect():
        text = r.text.translate(licences.UPPER)
        words_, labels = licences.WORD.findall(text), set(licences.brute_base(r.text)[4].split(",")) - {""}
        miss = 1.0
        for phrase, (label, _) in licences.NOTICES.items():
            p = phrase.split()
            if any(words_[i : i + len(p)] == p for i in range(len(words_))):
                labels.add(label)
        for m in re.finditer(r"license-identifier:[ \t]*([^\n]*)", text):
            rpn = next((x for n in range(len(m[1].split()), 0, -1) if (x := licences.parse_expression(" ".join(m[1].split()[:n]).rstrip(".:")))), None)
            labels.update(licences.licences_of(rpn or []))
            miss *= not licences.licences_of(rpn or [])
        got = licences.Scanner().scan(r.text)
        assert got[5] == ",".join(sorted(labels)) and (got[6] == 1) == (miss == 0) and (got[6] > 0) == bool(labels)


def test_licences(spark, documents, edge_docs, no_docs):
    for docs in (documents, edge_docs):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(licences.brute_base(r.text))
        for r in licences.digest(licences.scan_licences(docs)).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in texts[r.doc_id] and 0 <= r.score <= 1
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licences.scan_licences(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "CC-BY cc by. All Rights\nReserved!"), (2, "# SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD"), (3, "General public  license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(rows).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (3, 0, 4, "cc-by,reserved")
    assert got[2].expressions == ["mit gpl-2.0+ or bsd and"] and got[2].labels == "bsd,gpl-2.0+,mit" and got[2].score == 1
    assert got[3].base_labels == "gpl"


def test_rows_of_tags():
    """An expression ends where the next tag begins, so rows of tags take linear time."""
    import time

    scanner = licences.Scanner()
    assert scanner.scan("SPDX-License-Identifier: MIT or SPDX-License-Identifier: GPL-2.0 and BSD")[7] == ["mit", "gpl-2.0 bsd and"]

    def took(n):
        began = time.process_time()
        assert len(scanner.scan("SPDX-License-Identifier: MIT " * n)[7]) == n
        return time.process_time() - began

    took(100)
    short, long = min(took(1000) for _ in range(3)), min(took(8000) for _ in range(3))
    assert long < 20 * short, (short, long)


# -- html --


def test_html(spark, sf, no_docs):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in H.extract_text(pages).collect()}
    import html

    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("<p>1 < 2 &amp; 3&nbsp;&#52;", "1 < 2 & 3 4"),
    ("<script>if (a<b) x='</p>'</script><p>Text.</p><!-- <p>no</p> --><style>p{}</style>", "Text."), ("<p>un<b>clo</b>sed<br>line", "unclosed line"), ("<p>kept<!-- open", "kept"),
    ("<body class='has-sidebar'><nav><a>Home</a></nav><div class=content><h1>Title</h1><p>Some text, of course.</p><div class='comments'><p>First!</p></div></div><footer>(c)</footer>", "Title\nSome text, of course."),
    ("<article><p>One.</p><aside>No.</aside><form><label>Name</label></form><ul><li>a<li>b</ul><div class='ad banner'>Buy</div><p hidden>x</p><p>Two.</p></article><p>outside</p>", "One.\na\nb\nTwo."),
    ("<article><table><tr><td>a<td>b</table><figure><figcaption>Cap</figcaption></figure></article>", "a\nb\nCap"), ("<div role='navigation'>menu</div><main><section><p>x.</p></section></main>", "x."),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert H.main_text(page) == text


STORY = "<p>" + "The river rose in the night, and by noon, as the old miller said, it had reached the bridge. " * 3 + "</p>"
TOLD = "\n".join(["The river rose in the night, and by noon, as the old miller said, it had reached the bridge. " * 2 + "The river rose in the night, and by noon, as the old miller said, it had reached the bridge."] * 4)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=post><h1>Flood</h1>{STORY * 4}</div><article><h2>Next</h2><p>A teaser</p></article>", "Flood\n" + TOLD),
        (f"<div><h1>Flood</h1>{STORY * 4}</div><article class=comment>{STORY}</article>", "Flood\n" + TOLD),
        (f"<article class='post tag-legal'>{STORY * 4}<article><p>Well said, thanks, all!</p></article></article>", TOLD),
        (f"<article>{STORY * 4}<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><div>More here</div></article>", TOLD),
        (f"<div><div>{STORY * 2}<ul><li>flour<li>salt</ul>{STORY * 2}</div><div><a href=x>Home</a> <a href=y>Map</a></div></div>", "\n".join([*TOLD.split("\n")[:2], "flour", "salt", *TOLD.split("\n")[2:]])),
    ],
)
def test_selected_paths(page, text):
    assert H.main_text(page) == text


MISLEADING = ["legal-text", "search-results", "share-price-report", "form-factor", "menu-planning", "copyright-law", "form", "related", "alert"]


@pytest.mark.parametrize("name", MISLEADING)
def test_names_are_no_verdict(name):
    assert H.main_text(f"<nav><a href=x>Home</a></nav><div class={name}><h1>Flood</h1>{STORY * 4}</div><div class=ad>Buy</div>") == "Flood\n" + TOLD
    if "-" in name and name != "legal-text":  # a part of the story under such a name
        assert H.main_text(f"<article><h1>Flood</h1>{STORY * 2}<section class={name}>{STORY * 2}</section></article>") == "Flood\n" + TOLD


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>One</h1>{STORY * 2}</article><article><h1>Two</h1>{STORY * 2}</article>", "One\n" + "\n".join(TOLD.split("\n")[:2]) + "\nTwo\n" + "\n".join(TOLD.split("\n")[:2])),
        (f"<header><a href=x>Site</a></header><article><header><h1>Flood</h1></header>{STORY * 4}</article>", "Flood\n" + TOLD),
        (f"<div><div><h1>Flood</h1>{STORY * 4}</div><div>Buy</div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>", "Flood\n" + TOLD),
        (f"<form id=aspnet><div><h1>Flood</h1>{STORY * 4}<input><button>Send</button></div></form>", "Flood\n" + TOLD),
        (f"<div><p>{STORY[3:-4]}<span class=ad>Buy</span> And <a href=x>so</a> on.</p>{STORY}</div>", TOLD.split("\n")[0] + " And so on.\n" + TOLD.split("\n")[0]),
        (f"<main><h1>Flood</h1>{STORY * 4}<div id=comments>{'<div class=comment><p>Well said, thanks, all! I was there, too.</p></div>' * 6}</div></main>", "Flood\n" + TOLD),
        ("<nav>Home</nav><footer>(c) us</footer>", ""), ("<article><h1>Flood</h1><p>Soon.</p></article>", "Flood\nSoon."),
    ],
)
def test_pages_of_many_kinds(page, text):
    assert H.main_text(page) == text


LINKS = "<ul><li><a href=a>Report of the council</a><li><a href=b>A second source</a></ul>"
LINKED = "Report of the council\nA second source\n"


@pytest.mark.parametrize("tag", ["article", "div class=post", "main"])
def test_nothing_of_the_story_is_lost(tag):
    page = lambda inner: H.main_text(f"<body><nav><a href=x>Home</a></nav><{tag}>{STORY * 2}{inner}{STORY * 2}</{tag.split()[0]}><div>Imprint</div><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></body>")
    told = TOLD.split("\n")[0] + "\n" + TOLD.split("\n")[0] + "\n"
    # Names of inline elements and of paragraphs.
    inline = "lost <span class='share'>40 percent</span> of its <em class='menu'>value</em>, <b class='ad-hoc'>as such</b>"
    assert page(f"<p>It {inline}.</p>") == told + "It lost 40 percent of its value, as such.\n" + told[:-1]
    assert page(f"<p class='promo-free legal'>{STORY[3:-4]}</p>") == told + told.split("\n")[0] + "\n" + told[:-1]
    assert page("<p class=ad>Buy now</p><div class='share'>Share this</div>") == told + told[:-1]
    # Linked lists and bare lines among paragraphs, and below a heading at the end.
    assert page(LINKS) == told + LINKED + told[:-1]
    assert page("".join(f"<div>Line {i}</div>" for i in range(12))) == told + "".join(f"Line {i}\n" for i in range(12)) + told[:-1]
    end = f"<{tag}>{STORY * 4}<h2>Sources</h2>{LINKS}<div class=share>Share</div></{tag.split()[0]}><div>Imprint</div>"
    assert H.main_text(end) == TOLD + "\nSources\n" + LINKED[:-1]


def test_paths_decide(spark, sf, monkeypatch):
    """The score of its path, and nothing else, selects a unit."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [H.main_text(p) for p in pages]
    monkeypatch.setattr(H, "content_paths", lambda page: set(range(len(page.paths))))
    assert all(len(H.main_text(p)) > len(w) for p, w in zip(pages, want, strict=True))
    monkeypatch.setattr(H, "content_paths", lambda page: set())
    assert not any(map(H.main_text, pages))


def test_articles_without_their_tag(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        assert H.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == H.main_text(r.html)


def test_odd_pages(spark):
    rows = [(None, None, None, "x"), (1, None, "<p>a, b.", "y"), (1, None, "<p>a, b.", "y"), (2, "u", "", None)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, None, "", 0), (1, None, "a, b.", 5), (1, None, "a, b.", 5), (2, "u", "", 0)], key=str)


def test_long_page():
    import tracemalloc

    page = "<div>" * 3000 + "<p>word, and more. </p>" * 20_000
    tracemalloc.start()
    assert H.main_text(page).count("\n") == 19_999
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


# -- language --


def test_language(spark, documents, edge_docs, no_docs):
    rows = language.identify_languages(documents).collect()
    known = {r.doc_id: r.lang for r in documents.collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == documents.count() and held and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    got = language.identify(edge_docs, language.learn(documents)).collect()
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == 4 and len(got) == edge_docs.count()
    assert language.identify_languages(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify(documents, language.learn(no_docs)).collect()} == {"und"}
    one = language.learn(documents.where("lang = 'fr'"))
    assert {r.lang_pred for r in language.identify(documents, one).collect()} == {"fr"}


# -- quality --


def statistics(text):
    w = SPACE.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics(spark, documents, edge_docs, no_docs):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f g h " * 3 + "x", "a " * 7, "a " * 9, "   x\n ", "x\nx\n\n x\nx", "a\x0bb\x0cc\x1cd", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0"])], "doc_id long, text string")
    for docs in (documents, edge_docs, odd):
        want = defaultdict(list)
        for r in docs.collect():
            want[r.doc_id].append(statistics(r.text))
        for r in quality.digest(quality.apply_rules(docs, [])).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want[r.doc_id]
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.apply_rules(no_docs, []).count() == 0


def test_rules(spark, sf, documents, no_docs):
    docs, labels = (spark.read.parquet(f"{sf[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_rules(docs, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.apply_rules(docs, rules).collect() if r.doc_id in known]
    good = [r for r in rows if known[r.doc_id] == 1 and not r.base_failed]
    bad = [r for r in rows if known[r.doc_id] == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)
    for r in rows[:100]:  # conditions and rules say the same
        row = quality.add_statistics(docs.where(f"doc_id = {r.doc_id}")).select(*(c.alias(k) for k, c in quality.features().items())).first() if r.rule is not None and r.doc_id % 7 == 0 else None
        assert row is None or quality.covers(rules[r.rule], row.asDict())
    assert quality.learn_rules(no_docs, labels) == [] and quality.learn_rules(docs, labels.limit(0)) == [] and quality.learn_rules(docs, labels.where("quality = 1")) == []


def all_statistics(text):
    """The statistics that rules test, from the text alone."""
    text = text or ""
    n, chars, symbols, dup, repeat = statistics(text)
    w, lines = SPACE.findall(text), [x for x in text.split("\n") if SPACE.search(x)]
    upper, digits = len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text))
    of, letters = max(n, 1), max(chars, 1)
    return {
        "n_words": float(n), "mean_word": chars / of, "symbol_share": symbols / letters, "dup_line_share": dup / max(len(lines), 1), "repeat_share": repeat / of,
        "distinct_share": len(set(w)) / of, "lines_per_word": len(lines) / of, "upper_share": upper / letters, "digit_share": digits / letters,
    }


def test_verdicts_by_brute_force(spark, sf):
    """Every document's verdict is what the list says of its statistics, rule by rule."""
    docs, labels = (spark.read.parquet(f"{sf[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.learn_rules(docs, labels)
    assert rules
    got = {r.doc_id: (r.kept, r.rule) for r in quality.digest(quality.apply_rules(docs, rules)).collect()}
    rejected = 0
    for r in docs.collect():
        known = all_statistics(r.text)
        first = next((i for i, rule in enumerate(rules) if all(known[t.feature] > t.cut if t.above else known[t.feature] <= t.cut for t in rule)), None)
        failed = known["n_words"] < 20 or known["repeat_share"] > 0.3
        assert got[r.doc_id] == (not failed and first is None, first)
        rejected += not failed and first is not None
    assert rejected > 10


def test_held_out_labels(spark, sf):
    """Rows whose label no rule has seen, in growing, pruning or the test of precision."""
    docs, labels = (spark.read.parquet(f"{sf[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    rules = quality.learn_rules(docs, labels.where(~held))
    judged = quality.digest(quality.apply_rules(docs, rules)).join(labels.where(held), "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    good, bad = [counts.get((q, True), 0) + counts.get((q, False), 0) for q in (1, 0)]
    assert good > 80 and bad > 3 and counts.get((1, True), 0) >= 0.97 * good and counts.get((0, False), 0) >= 0.75 * bad


def test_grow_by_brute_force():
    """Each term has the highest gain of all terms that there are, and rules cover no good row or can't grow on."""
    import math

    for seed in range(20):
        rng = random.Random(seed)
        rows = [{f: float(rng.randint(0, 6)) for f in quality.FEATURES} | {"bad": rng.random() < 0.4} for _ in range(rng.randint(5, 40))]
        for r in rows:
            r["bad"] = r["bad"] or r["n_words"] > 4 and r["mean_word"] <= 2
        left = rows
        for term in quality.grow(rows):
            bad = sum(r["bad"] for r in left)

            def gain(f, cut, above, left=left, bad=bad):
                inside = [r["bad"] for r in left if (r[f] > cut) == above]
                return sum(inside) * (math.log2(sum(inside) / len(inside)) - math.log2(bad / len(left))) if any(inside) else 0.0

            best = max(gain(f, cut + 0.5, above) for f in quality.FEATURES for cut in range(-1, 7) for above in (True, False))
            assert abs(gain(term.feature, term.cut, term.above) - best) < 1e-6
            left = [r for r in left if (r[term.feature] > term.cut) == term.above]


# -- archive --


def test_archive(spark, sf, tmp_path):
    long = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u WARC-Type: x", "é" * 600), (7, "u", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.digest(archive).collect()}
    n = len(long)
    assert got == {(1, "revisit", 3, n), (2, "revisit", 3, n), (3, "response", None, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (None, "revisit", 3, n), (7, "response", None, 1200)}
    assert archive.payloads.count() == 4
    parsed = [(warc.parse_record(r.record), r.record) for r in archive.records().collect()]
    assert len({f["WARC-Record-ID"] for (f, _), _ in parsed}) == len(rows)  # repeated and null ids are told apart
    records = {f["WARC-Record-ID"].split(":")[2]: (f, block, whole) for (f, block), whole in parsed}
    assert records["3"][1].decode() == long and records["3"][2].endswith(f"Content-Length: {n}\r\n\r\n{long}\r\n\r\n".encode())
    assert records["1"][1] == b"" and records["1"][0]["WARC-Refers-To"] == "<urn:page:3>" and records["2"][0]["WARC-Target-URI"] == "http://a/2X: y" and "WARC-Target-URI" not in records["3"][0]
    assert {r.url for r in archive.read().collect()} == {"http://a/1", "http://a/2X: y", None, "u", "u\u2028WARC-Type: x"}
    # Files of whole records, one after the other, give the same back.
    files = archive.export(f"file://{tmp_path}/w").collect()
    assert sum(r.records for r in files) == len(rows)
    told = b"".join(open(r.path, "rb").read() for r in files)
    assert sorted(told.split(b"WARC/1.1\r\n")) == sorted(b"".join(r for _, r in parsed).split(b"WARC/1.1\r\n"))
    clash = pages.selectExpr("*", "1 AS sha256", "'x' AS frame", "2 AS number", "3 AS payload")
    assert sorted(map(str, warc.digest(warc.write_archive(clash)).collect())) == sorted(map(str, warc.digest(archive).collect()))
    assert warc.digest(warc.write_archive(pages.limit(0))).count() == 0
    # A payload that no longer has its digest, or is gone, stops the job; so does a revisit whose response says otherwise.
    import zstandard

    frame = zstandard.compress(b"other").hex()
    for bad, why in ((f"SELECT sha256, X'{frame}' AS frame FROM payloads", "damaged"), ("SELECT * FROM payloads LIMIT 0", "missing")):
        archive.payloads.createOrReplaceTempView("payloads")
        broken = warc.Archive(spark, f"{tmp_path}/{why}")
        spark.sql(bad).write.parquet(f"{broken.folder}/payloads")
        archive.headers.write.parquet(f"{broken.folder}/headers")
        with pytest.raises(Exception, match=why):
            broken.read().collect()
    broken = warc.Archive(spark, f"{tmp_path}/alone")
    archive.payloads.write.parquet(f"{broken.folder}/payloads")
    archive.headers.where("record_type = 'revisit'").write.parquet(f"{broken.folder}/headers")
    with pytest.raises(Exception, match="without its response"):
        broken.read().collect()


def test_archive_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(map(tuple, warc.digest(warc.write_archive(spark.read.parquet(f"{sf}/pages.parquet"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert got == sorted(con.sql(warc.ORACLE).fetchall())


# -- pipeline --


def test_pipeline(spark, sf, documents):
    import corpus_pipeline as cp
    from leafmill.llm.common import stage

    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "benchmark_decontamination", "packing"]
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "!!! 123", "en", "s", 7), (0, documents.orderBy("doc_id").first().text, "en", "s", 1), (0, documents.orderBy("doc_id").first().text, "en", "s", 1)], documents.schema)
    docs, kept = documents.unionByName(odd), []
    for name, f in cp.STAGES:
        docs, _ = stage(f(spark, docs, sf), f"test-{name}")
        kept.append(docs)
    first, second, third, fourth, last = kept
    assert all(d.columns == cp.COLUMNS for d in kept[:4])
    assert first.where(f"doc_id >= {10**9}").count() == 0 and first.count() >= documents.count()
    from leafmill.llm import jaccard

    least = {(r.doc_id, r.component_id) for r in jaccard.similar_documents(first).collect()}
    assert sorted(r.doc_id for r in second.collect()) == sorted({d for d, c in least if d == c})
    assert third.count() == second.count() and fourth.count() < third.count()
    texts = {r.doc_id: r.text for r in second.collect()}
    assert all(r.n_chars == len(r.text) and len(r.text) <= len(texts[r.doc_id]) for r in third.collect())
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in fourth.collect()}
    assert cp.ORACLE_SQL is None
    for name, f in cp.STAGES:  # empty tables
        assert f(spark, documents.limit(0), sf).count() == 0


def test_repeated_and_null_ids(spark, sf, documents):
    import corpus_pipeline as cp

    random.seed(11)
    prose = lambda: " ".join(f"k{random.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d = prose(), prose(), prose(), prose()
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], documents.schema)
    got = lambda f, rows: sorted(((r.doc_id, r.text) for r in f(spark, table(rows), sf).collect()), key=str)
    rows = [(5, a), (5, b), (None, c), (None, c), (None, d), (3, d + " more"), (9, a), (9, a)]
    assert got(cp.near_duplicates, rows) == sorted([(5, a), (5, b), (None, c), (3, d + " more")], key=str)
    rows = [(5, a), (5, b + " " + leak), (None, c + " " + leak), (None, d)]
    assert got(cp.benchmark_decontamination, rows) == sorted([(5, a), (None, d)], key=str)


def test_foreign(spark, sf, documents):
    import corpus_pipeline as cp

    random.seed(1)
    texts = [
        "Joki nousi yön aikana ja puoleenpäivään mennessä, kuten vanha mylläri sanoi, se oli saavuttanut kylän sillan ja pellot. ",
        "Река поднялась ночью, и к полудню, как сказал старый мельник, вода дошла до моста у деревни и залила все поля вокруг. ",
        "Rzeka wezbrała w nocy i do południa, jak powiedział stary młynarz, woda dotarła do mostu przy wsi i zalała wszystkie pola. ",
        " ".join("".join(random.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(60)),
    ]
    odd = spark.createDataFrame([(10**9 + i, t * 3, None, "s", len(t) * 3) for i, t in enumerate(texts)], documents.schema)
    kept = {r.doc_id for r in cp.language_id(spark, documents.unionByName(odd), sf).collect()}
    assert kept == {r.doc_id for r in documents.collect()}


def test_sample_bounds(documents):
    assert len(language.learn(documents, sample_rows=5).within) == 2
    assert np.isfinite(language.vector(language.features("ab cd"))).all()
