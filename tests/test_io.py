import pytest
from pyspark.sql import functions as F

from leafmill.functions import files as N
from leafmill.plans.pipeline import Pipeline, PipelineError, book_pipeline
from leafmill.sources import files as S
from leafmill.sources import manifests as M
from leafmill.sources import sinks as K
from leafmill.streaming.clean import clean_stream, read_documents


def test_files(spark, tmp_path):
    (tmp_path / "a#t.txt").write_text("x START  body text END y")
    (tmp_path / "b#t.pdf").write_bytes(b"%PDF-1.5 rest")
    files = S.binary_files(spark, str(tmp_path))
    assert {r.length for r in files.select("length").collect()} == {24, 13}
    assert S.text_files(spark, f"{tmp_path}/a*").first().text.startswith("x START")
    got = {r.text: r.issue for r in S.pdf_text(files.where("path like '%pdf'"), lambda b: (1, b.decode()[:4])).collect()}
    assert got == {"%PDF": None}
    assert S.pdf_text(files, lambda b: 1 / 0).where("issue like 'ZeroDivisionError%'").count() == 2


def test_manifests(spark, tmp_path):
    folder = str(tmp_path)
    assert not M.exists(folder, "a#t")
    M.create(folder, "a#t", text_before="START", text_after="END", structure=["# One"])
    M.update(folder, "a#t", page_count=3)
    got = M.load(folder, "a#t")
    assert got["author"] == "a" and got["page_count"] == 3 and got["structure"] == ["# One"] and M.available(folder) == ["a#t"]
    assert M.table(spark, folder).first().text_after == "END"
    types = {"default": {"text-removal-patterns": ["d"]}, "x": {"text-removal-patterns": ["a", "b"]}, "y": {"text-removal-patterns": ["b", "c"]}}
    assert M.removal_patterns(types, "x") == ["a", "b"] and M.removal_patterns(types, "z") == ["a", "b", "c"] and M.book_types(f"{folder}/none") is None


def test_pipeline(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a#t.txt").write_text("x START  body text\n- 3 - END y")
    M.create(str(tmp_path / "m"), "a#t", text_before="START", text_after="END")
    run = book_pipeline(M.table(spark, str(tmp_path / "m")))
    r = run.run(S.binary_files(spark, str(tmp_path / "in"))).first()
    assert r.config_key == "a#t" and r.format == "txt" and r.confidence == pytest.approx(0.3)
    assert r.cleaned_text == "body text" and r.issues == ["validation"] and r.mime == "text/plain" and not r.is_valid
    assert run.progress == 100
    written = book_pipeline(M.table(spark, str(tmp_path / "m")), markdown_folder=f"file://{tmp_path}/md").run(S.binary_files(spark, str(tmp_path / "in"))).first()
    assert written.name == "a#t" and (tmp_path / "md/a#t.md").read_text() == "body text"
    with pytest.raises(PipelineError, match="bad"):
        Pipeline().add("bad", lambda d: d.select("nothing")).run(spark.range(1))
    assert Pipeline({"x": lambda d: d.select("nothing")}, enabled=set()).run(spark.range(1)).count() == 1


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("k1", "raw", "", "pdf-text-ocr"), ("k2", "raw2", None, "text")], "config_key string, text string, ocr_text string, file_type string")
    K.write_raw(raw, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/stage=raw")
    assert [r.text for r in back.where("source = 'ocr'").collect()] == [K.EMPTY_OCR]
    cleaned = spark.createDataFrame([("k1", "txt", "clean")], "config_key string, source string, text string")
    K.write_cleaned(cleaned, str(tmp_path))
    keys = spark.createDataFrame([("k1",), ("k2",), ("k4",)], "config_key string")
    best = {r.config_key: r.text for r in K.best_text(keys, back, spark.read.parquet(f"{tmp_path}/stage=cleaned")).collect()}
    assert best == {"k1": "clean", "k2": "raw2", "k4": None}
    assert K.write_markdown(spark.createDataFrame([("b", "# T")], "name string, text string"), f"file://{tmp_path}/md").count() == 1
    assert (tmp_path / "md/b.md").read_text() == "# T"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a line that\ngoes on"), (2, "[1]")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    q = clean_stream(read_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination(60)
    assert {r.doc_id: r.cleaned_text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "a line that goes on", 2: ""}


def test_names(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(N.duration(F.lit(61_500))) == "1m 1s" and get(N.duration(F.lit(900))) == "0s"
    assert get(N.pdf_version(F.lit(b"%PDF-1.7x"))) == "1.7" and get(N.is_likely_text(F.lit(b""))) is False
