"""Runs with state, kept results, metrics, manifests by tasks, PDF validation, configuration by rows."""

import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from leafmill.functions.lines import CleanOptions, RowOptions
from leafmill.operators.clean import clean_text
from leafmill.plans import config
from leafmill.plans.pipeline import Cancelled, Pipeline, PipelineError, book_pipeline, clean_metrics, detect, observed
from leafmill.sources import files as S
from leafmill.sources import manifests as M
from leafmill.sources import sinks as K
from leafmill.sources import store


@pytest.fixture
def plain_pages():
    """A stand-in for an extractor: pages of text behind form feeds."""

    def pages_of(content, limit=None):
        pages = content.decode("latin-1").split("\f")[1:]
        if "broken" in content[:20].decode("latin-1"):
            raise ValueError("broken")
        return len(pages), "".join(pages[: limit or None] if limit != 0 else [])

    return pages_of


# -- results kept from scan to scan -----------------------------------------------------------


def test_page_counts(spark, tmp_path, plain_pages):
    files, state = tmp_path / "in", f"file://{tmp_path}/state"
    files.mkdir()
    (files / "a#t.pdf").write_bytes(b"%PDF-1.4\fone\ftwo")
    (files / "b[1].pdf").write_bytes(b"%PDF-1.4\fone")
    (files / "broken.pdf").write_bytes(b"%PDF broken")
    (files / "c.txt").write_text("text")
    opened = spark.sparkContext.accumulator(0)

    def extract(content, limit=None):
        opened.add(1)
        return plain_pages(content, limit)

    def scan():
        before = opened.value
        found, read = S.page_counts(spark, str(files), state, extract)
        return {r.path.rpartition("/")[2]: r.page_count for r in found.collect()}, read, opened.value - before

    all_ = {"a#t.pdf": 2, "b[1].pdf": 1, "broken.pdf": 0, "c.txt": 0}
    assert scan() == (all_, 4, 3)
    assert scan() == (all_, 0, 0)  # nothing is opened
    time.sleep(1.1)
    (files / "b[1].pdf").write_bytes(b"%PDF-1.4\fone\ftwo\fthree")
    (files / "new.pdf").write_bytes(b"%PDF-1.4")
    assert scan() == (all_ | {"b[1].pdf": 3, "new.pdf": 0}, 2, 2)
    (files / "c.txt").unlink()
    kept = {k: v for k, v in all_.items() if k != "c.txt"} | {"b[1].pdf": 3, "new.pdf": 0}
    assert scan() == (kept, 0, 0) and scan() == (kept, 0, 0)
    assert len(store.children(spark, state)) == 1  # earlier versions go
    plan = S.binary_files(spark, str(files)).select("path", "modified", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


# -- runs -------------------------------------------------------------------------------------


def test_run_resumes(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/run", []

    def phase(name, fail=False):
        def run(df):
            calls.append(name)
            return df.withColumn(name, F.raise_error(F.lit("no")) if fail else F.col("id") + 1)

        return run

    told = []
    p = Pipeline().add("one", phase("one")).add("extract", phase("extract", fail=True)).add("three", phase("three"))
    run = p.start(spark, folder, lambda name, done: told.append((name, round(done))))
    with pytest.raises(PipelineError) as e:
        run.execute(spark.range(5))
    assert e.value.code == "EXTRACTION_FAILED" and e.value.context["done"] == ["one"] and "extract" in e.value.formatted()
    assert run.state["status"] == "failed" and round(run.progress) == 33 and not run.clean_up() and store.exists(spark, f"{folder}/00-one/_SUCCESS")
    p.phases["extract"] = phase("extract")
    again = p.start(spark, folder, lambda name, done: told.append((name, round(done))))
    assert again.execute(spark.range(5)).columns == ["id", "one", "extract", "three"]
    assert calls == ["one", "extract", "extract", "three"]  # the first phase isn't run again
    assert told == [("one", 33), ("extract", 67), ("three", 100)] and again.progress == 100
    state = again.state
    assert state["status"] == "completed" and [v["rows"] for v in state["phases"].values()] == [5, 5, 5]
    assert not again.clean_up(keep=True) and again.clean_up() and store.children(spark, folder) == ["state.json"] and not again.clean_up()


def test_run_cancelled(spark, tmp_path):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    p = Pipeline().add("one", lambda d: d.withColumn("a", F.lit(1))).add("slow", lambda d: d.withColumn("b", slow("id"))).add("last", lambda d: d)
    run, error = p.start(spark, f"file://{tmp_path}/run"), []

    def work():
        try:
            run.execute(spark.range(0, 2, 1, 2))
        except PipelineError as e:
            error.append(e)

    t = threading.Thread(target=work)
    began = time.monotonic()
    t.start()
    while "one" not in run.state["phases"] and time.monotonic() - began < 60:
        time.sleep(0.1)
    time.sleep(1)
    other = spark.range(10).count()  # jobs of others go on
    run.cancel()
    t.join(60)
    assert other == 10 and not t.is_alive() and isinstance(error[0], Cancelled)
    assert run.state["status"] == "cancelled" and list(run.state["phases"]) == ["one"] and round(run.progress) == 33 and not run.clean_up()
    p.phases["slow"] = lambda d: d.withColumn("b", F.lit(2))
    assert p.start(spark, f"file://{tmp_path}/run").execute(spark.range(4)).count() == 2  # what the first phase had written


# -- metrics ----------------------------------------------------------------------------------


def test_metrics(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, found = observed(clean_text(docs))
    out.write.parquet(f"{tmp_path}/out")
    want = spark.read.parquet(f"{tmp_path}/out").agg(*clean_metrics()).first().asDict()
    assert found.get == want and want["documents"] == docs.count() and want["original_lines"] > want["final_lines"]

    class Listener(StreamingQueryListener):
        rows = []

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            if "clean" in event.progress.observedMetrics:
                self.rows.append(event.progress.observedMetrics["clean"].asDict())

        def onQueryTerminated(self, event):
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    q = clean_text(stream).observe("clean", *clean_metrics()).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(100):
        if listener.rows:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(r["documents"] for r in listener.rows) == want["documents"] and sum(r["final_lines"] for r in listener.rows) == want["final_lines"]


# -- manifests --------------------------------------------------------------------------------


def test_manifests_by_tasks(spark, tmp_path):
    folder = f"file://{tmp_path}/m"
    M.create(f"{tmp_path}/m", "a#t", text_before="START", size=7)
    (tmp_path / "m/a#t" / M.NAME).write_text((tmp_path / "m/a#t" / M.NAME).read_text() + "own-key: kept\n")
    (tmp_path / "m/bad").mkdir()
    (tmp_path / "m/bad" / M.NAME).write_text("a: [1")
    (tmp_path / "m/default").mkdir()
    (tmp_path / "m/default" / M.NAME).write_text("author: x")
    books = spark.createDataFrame([("a#t", "# A\n\none two three four five six\n\n# FUSSNOTEN\n\n[M] note"), ("ü#new#2", "x"), ("../out", "x"), ("", "x"), (None, "x")], "config_key string, text string")
    changes = M.from_books(books)
    assert {r.config_key: r.changed for r in M.update_all(spark, folder, changes).collect()} == {"a#t": True, "ü#new#2": True}
    assert {r.changed for r in M.update_all(spark, folder, changes).collect()} == {False}  # a second attempt writes the same
    rows = {r.config_key: r for r in M.table(spark, folder).collect()}
    assert set(rows) == {"a#t", "ü#new#2", "bad"} and "ParserError" in rows["bad"].issue and rows["bad"].file_type == "text"
    a, new = rows["a#t"], rows["ü#new#2"]
    assert a.structure == ["# A", "one two three four five"] and a.footnotes == ["note"] and a.text_before == "START" and a.size == 7 and a.issue is None
    assert (new.author, new.title, new.book_index, new.structure) == ("ü", "new", "2", ["x"])
    assert "own-key: kept" in (tmp_path / "m/a#t" / M.NAME).read_text() and not list((tmp_path / "m").rglob("*.tmp"))
    bad = M.update_all(spark, folder, spark.createDataFrame([("bad", 1)], "config_key string, size long")).first()
    assert not bad.changed and "ParserError" in bad.issue and (tmp_path / "m/bad" / M.NAME).read_text() == "a: [1"
    joined = M.with_manifests(spark.createDataFrame([("a#t",), ("none",)], "config_key string"), M.table(spark, folder))
    assert {r.config_key: r.text_before for r in joined.collect()} == {"a#t": "START", "none": None}
    beyond = M.with_manifests(spark.createDataFrame([("a#t",)], "config_key string"), M.table(spark, folder), limit=0)
    assert beyond.first().size == 7 and "broadcast" not in beyond._jdf.queryExecution().analyzed().toString().lower()
    once = M.Manifests(spark, folder)
    assert once.get() is once.get() and once.get().storageLevel.useMemory
    once.clear()
    assert once.get().count() == 3
    once.clear()


def test_template(spark, tmp_path):
    """New manifests are made from the default one, by tasks and on the driver."""
    (tmp_path / "default").mkdir()
    (tmp_path / "default" / M.NAME).write_text("author: ''\ntitle: ''\noriginal:\n  format: pdf\n  book-type: novel\ntext-before-first-chapter: START\n")
    changes = spark.createDataFrame([("a#t", 5), ("b#u#2", None)], "config_key string, size long")
    assert M.update_all(spark, f"file://{tmp_path}", changes).where("changed").count() == 2
    M.create(str(tmp_path), "c#v")
    rows = {r.config_key: r for r in M.table(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.author, r.title, r.book_index, r.text_before, r.file_type, r.size) for k, r in rows.items()} == {
        "a#t": ("a", "t", None, "START", "pdf", 5), "b#u#2": ("b", "u", "2", "START", "pdf", 0), "c#v": ("c", "v", None, "START", "pdf", 0),
    }
    assert "book-type: novel" in (tmp_path / "a#t" / M.NAME).read_text()
    M.update_all(spark, f"file://{tmp_path}", spark.createDataFrame([("a#t", "x")], "config_key string, author string")).count()
    assert M.load(str(tmp_path), "a#t")["author"] == "x" and M.load(str(tmp_path), "a#t")["size"] == 5


def test_many_manifests(spark, tmp_path):
    changes = spark.range(2000).select(F.concat(F.lit("a"), "id", F.lit("#t")).alias("config_key"), F.col("id").alias("size"))
    assert M.update_all(spark, f"file://{tmp_path}", changes).where("changed").count() == 2000
    got = M.table(spark, f"file://{tmp_path}").agg(F.sum("size"), F.count_if(F.col("issue").isNull()), F.min("title")).first()
    assert tuple(got) == (1999 * 1000, 2000, "t")


def test_manifests_without_listing(spark, tmp_path):
    """Updates and reading go by names and list no files through Spark, which asks for each file's owner in a process of its own; hidden
    keys, folders with a space and manifests further down are found."""
    folder = f"{tmp_path}/a b"
    changes = spark.createDataFrame([("_a#t", 1), ("b#t", 2)], "config_key string, size long")
    assert "binaryFile" not in M.update_all(spark, folder, changes)._jdf.queryExecution().toString() and M.update_all(spark, folder, changes).count() == 2
    more = M.update_all(spark, folder, spark.createDataFrame([("_a#t", "z")], "config_key string, author string"))
    assert more.first().changed and more.rdd.getNumPartitions() > 1
    (tmp_path / "a b/below/c#t").mkdir(parents=True)
    (tmp_path / "a b/below/c#t" / M.NAME).write_text("author: c\n")
    found = M.table(spark, folder)
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert {(r.config_key, r.author, r.size) for r in found.collect()} == {("_a#t", "z", 1), ("b#t", "b", 2), ("c#t", "c", 0)}
    assert M.table(spark, f"{tmp_path}/none").count() == 0


def test_markdown_again(spark, tmp_path):
    books = spark.createDataFrame([("a/b", "one"), (None, "two"), ("c", None)], "name string, text string")
    for text in ("one", "other"):
        K.write_markdown(books.withColumn("text", F.when(F.col("name") == "a/b", text).otherwise(F.col("text"))), f"file://{tmp_path}/md").count()
        assert (tmp_path / "md/a_b.md").read_text() == text
    assert (tmp_path / "md/_.md").read_text() == "two" and (tmp_path / "md/c.md").read_text() == "" and len(list((tmp_path / "md").iterdir())) == 3


# -- PDF validation ---------------------------------------------------------------------------


def test_pdf_validation(spark, tmp_path, plain_pages):
    image = " /XObject << /Subtype /Image >> "
    cases = {
        "none.pdf": ("%PDF-1.7 ", (False, "empty", 0.0, [], ["PDF has no pages"])),
        "scan.pdf": ("%PDF-1.7 " + image + "\f\f", (True, "image_based", 0.0, [1], ["PDF contains images without embedded text (requires OCR processing)"])),
        "bare.pdf": ("%PDF-1.7 \fshort", (True, "empty", 0.0, [], ["PDF has no embedded text and no detected images"])),
        "mixed.pdf": ("%PDF-1.7 " + image * 6 + ("\f" + "x" * 150) * 7, (True, "hybrid", 75.0, [1, 2], ["PDF has mixed content (text and 2 images)"])),
        "thin.pdf": ("%PDF-1.7 " + image + "\f" + "x" * 110, (True, "image_based", 55.0, [1], ["PDF is primarily image-based (1 images, low text coverage)"])),
        "some.pdf": ("%PDF-1.7 " + ("\f" + "x" * 60) * 2, (True, "text_based", 30.0, [], ["PDF has moderate text content"])),
        "full.pdf": ("%PDF-1.7 \f" + "x" * 500, (True, "text_based", 100.0, [], [])),
        "odd.pdf": ("%PDF-broken", (False, "empty", 0.0, [], ["PDF parsing failed: ValueError: broken"])),
    }
    for name, (body, _) in cases.items():
        (tmp_path / name).write_text(body, encoding="latin-1")
    (tmp_path / "text.txt").write_text("plain words")
    files = S.binary_files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: r for r in detect(files, plain_pages).collect()}
    for name, (_, want) in cases.items():
        r = got[name]
        assert (r.is_valid, r.content_type, pytest.approx(r.coverage), list(r.image_pages), list(r.issues)) == (want[0], want[1], want[2], want[3], want[4]), name
    assert got["mixed.pdf"].page_count == 7 and got["mixed.pdf"].pdf_version == "1.7" and got["odd.pdf"].pdf_version == "unknown" and got["text.txt"].content_type is None and got["text.txt"].issues == ["validation"]
    texts = {r.path.rpartition("/")[2]: r.text for r in book_pipeline(pdf=plain_pages).run(files).select("path", "text").collect()}
    assert len(texts["mixed.pdf"]) == 7 * 150 and texts["odd.pdf"] == "" and texts["text.txt"] == "plain words"


# -- configuration ----------------------------------------------------------------------------


def test_row_options(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    kinds = [CleanOptions(), CleanOptions(aggressive=True, extra_patterns=(r"^der\b", "a b")), CleanOptions(source="ocr", remove_toc=False), CleanOptions(remove_urls=False, remove_boilerplate=False)]
    of = lambda o: F.struct(F.lit(o.aggressive).alias("aggressive"), F.lit(o.remove_boilerplate).alias("remove_boilerplate"), F.lit(o.remove_urls).alias("remove_urls"), F.lit(o.remove_toc).alias("remove_toc"), F.array(*map(F.lit, o.extra_patterns)).cast("array<string>").alias("extra_patterns"), F.lit(o.source).alias("source"))
    choice = F.when(F.col("doc_id") % 4 == 0, of(kinds[0])).when(F.col("doc_id") % 4 == 1, of(kinds[1])).when(F.col("doc_id") % 4 == 2, of(kinds[2])).otherwise(of(kinds[3]))
    got = {r.doc_id: (r.cleaned_text, r.stats) for r in clean_text(docs.withColumn("o", choice), RowOptions.of(F.col("o"))).collect()}
    for k, o in enumerate(kinds):
        for r in clean_text(docs.where(F.col("doc_id") % 4 == k), o).collect():
            assert got[r.doc_id] == (r.cleaned_text, r.stats)


def test_layers(spark):
    docs = spark.createDataFrame([(1, "novel", "x"), (2, "novel", "y"), (3, "other", "x"), (4, None, None)], "doc_id long, kind string, book string")
    kinds = spark.createDataFrame([("novel", True, None, ["k"])], "kind string, aggressive boolean, remove_toc boolean, extra_patterns array<string>")
    books = spark.createDataFrame([("y", False, "ocr")], "book string, aggressive boolean, source string")
    got = {r.doc_id: r.options for r in config.configured(docs, (kinds, "kind"), (books, "book"), defaults=CleanOptions(remove_urls=False)).collect()}
    assert (got[1].aggressive, got[1].extra_patterns, got[1].source, got[1].remove_urls) == (True, ["k"], "pdf", False)
    assert (got[2].aggressive, got[2].source, got[2].remove_toc) == (False, "ocr", True) and (got[3].aggressive, got[3].extra_patterns) == (False, []) and not got[4].aggressive


# -- books from recognised pages ----------------------------------------------------------------


def test_recognised_books(spark, tmp_path):
    from leafmill.plans.pipeline import recognise

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a#t.txt").write_text("embedded text")
    (tmp_path / "in/b#u.txt").write_text("only embedded")
    symbol = {"text": "1", "y0": 0.0, "y1": 10.0, "base_y1": 40.0}
    line = lambda text, x0=300.0, symbols=(): {"text": text, "x0": x0, "y0": 0.0, "x1": 2100.0, "y1": 40.0, "symbols": list(symbols)}
    rows = [
        ("a#t", 1, [line("XIV", 1200.0), line("Es ist fiir alle, wie ein docu-"), line("ment sagt, WEG damit, und"), line("1 A note.", 320.0, [symbol])]),
        ("a#t", 2, [line("geht weiter auf der Seite."), line("w i t h a r e"), line("Ende.")]),
    ]
    schema = "config_key string, page_no int, lines array<struct<text:string,x0:double,y0:double,x1:double,y1:double,symbols:array<struct<text:string,y0:double,y1:double,base_y1:double>>>>"
    pages = spark.createDataFrame([(k, n, [tuple(x[c] if c != "symbols" else [tuple(s.values()) for s in x[c]] for c in ("text", "x0", "y0", "x1", "y1", "symbols")) for x in ls]) for k, n, ls in rows], schema)
    phase = recognise(pages, [[{"pattern": "{roman-number}"}]], {}, removals=("/WEG [a-z]+/", "(bad"))
    folder = f"file://{tmp_path}"
    steps = book_pipeline(recognised=phase, manifest_folder=f"{folder}/m", markdown_folder=f"{folder}/md")
    assert list(steps.phases) == ["detect", "extract", "recognise", "manifest", "clean", "markdown"]
    run = steps.start(spark, f"{folder}/run")
    assert {r.name for r in run.execute(S.binary_files(spark, str(tmp_path / "in"))).collect()} == {"a#t", "b#u"} and run.progress == 100
    a = (tmp_path / "md/a#t.md").read_text()
    assert a.startswith("# XIV") and "Es ist für alle, wie ein document sagt, , und geht weiter" in a and "[^1]: A note." in a and (tmp_path / "md/b#u.md").read_text() == "only embedded"
    m = M.load(f"{tmp_path}/m", "a#t")
    assert m["structure"][0] == "# XIV" and m["footnotes"] == ["[^1]: A note."] and M.load(f"{tmp_path}/m", "b#u")["structure"] == ["only embedded"]
    cleaned = spark.read.parquet(f"{folder}/run/04-clean")
    assert {r.config_key: (r.cleaned_ocr is None, r.cleaned_text) for r in cleaned.collect()} == {"a#t": (False, "embedded text"), "b#u": (True, "only embedded")}
    assert run.clean_up() and (tmp_path / "md/a#t.md").exists()
