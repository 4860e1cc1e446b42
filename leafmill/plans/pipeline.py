"""Detection, extraction, cleaning and selection: as one lazy chain, or phase by phase with state, metrics and cancelling."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import files as N
from leafmill.functions.lines import COUNTERS, CleanOptions
from leafmill.functions.text import boundary_slice, fix_umlauts, remove_patterns, valid_patterns
from leafmill.operators.clean import clean_text
from leafmill.operators.ocr import assemble_books, structure_pages
from leafmill.sources import store
from leafmill.sources.files import pdf_text
from leafmill.sources.manifests import from_books, update_all
from leafmill.sources.sinks import write_markdown

log = logging.getLogger("leafmill")
Phase = Callable[[DataFrame], DataFrame]


#: Codes of errors.
CODES = ("FILE_NOT_FOUND", "INVALID_FORMAT", "EXTRACTION_FAILED", "OCR_FAILED", "CONFIG_INVALID", "PIPELINE_FAILED", "API_ERROR", "VALIDATION_ERROR")
#: Which code a failing phase has; others have PIPELINE_FAILED.
PHASE_CODES = {"detect": "INVALID_FORMAT", "extract": "EXTRACTION_FAILED", "recognise": "OCR_FAILED", "configure": "CONFIG_INVALID"}


class PipelineError(Exception):
    """A phase failed: its code, name and operation, what is known besides, and the cause attached."""

    def __init__(self, code: str, phase: str, message: str, **context):
        super().__init__(f"{code} in {phase}: {message}")
        if code not in CODES:
            raise ValueError(f"no such code: {code}")
        self.code, self.phase, self.context = code, phase, context

    def formatted(self) -> str:
        known = ", ".join(f"{k}={json.dumps(v, default=str)}" for k, v in self.context.items())
        return f"{self} ({known})" if known else str(self)


class Cancelled(PipelineError):
    """The run was cancelled; what its phases had written is still there, and it can go on from it."""


def clean_metrics(stats: str = "stats") -> list[Column]:
    """Sums over clean_text's statistics, for observe: what a pass over the documents finds besides its result."""
    of = lambda c: F.coalesce(F.sum(f"{stats}.{c}"), F.lit(0)).alias(c.rpartition(".")[2])
    first = ["original_lines", "final_lines", "sections_stripped", "repeated_lines", "fuzzy_lines"]
    return [F.count(F.lit(1)).alias("documents"), *map(of, first), *(of(f"removed.{c}") for c in dict.fromkeys(COUNTERS.values()))]


def observed(cleaned: DataFrame, name: str = "clean") -> tuple[DataFrame, Observation]:
    """clean_text's result with its sums as metrics of the action that runs it: no second pass. A stream takes
    ``df.observe(name, *clean_metrics())``, and a listener gets them with each batch."""
    found = Observation(name)
    return cleaned.observe(found, *clean_metrics()), found


@dataclass
class Pipeline:
    """Phases by name, run in order; each takes a table and returns one. Switched-off and missing phases are passed over."""

    phases: dict[str, Phase] = field(default_factory=dict)
    enabled: set[str] | None = None
    done: list[str] = field(default_factory=list)

    def add(self, name: str, phase: Phase) -> Pipeline:
        self.phases[name] = phase
        return self

    @property
    def progress(self) -> float:
        todo = [p for p in self.phases if self.enabled is None or p in self.enabled]
        return 100 * len(self.done) / len(todo) if todo else 100.0

    def run(self, table: DataFrame) -> DataFrame:
        self.done.clear()
        for name, phase in self.phases.items():
            if self.enabled is not None and name not in self.enabled:
                continue
            try:
                table = table.transform(phase)
            except Exception as e:
                raise PipelineError(PHASE_CODES.get(name, "PIPELINE_FAILED"), name, str(e), done=list(self.done)) from e
            self.done.append(name)
            log.info("phase %s planned (%.0f %%)", name, self.progress)
        return table

    def start(self, spark: SparkSession, folder: str, notify: Callable[[str, float], None] | None = None) -> Run:
        """A run whose phases are written one by one below ``folder`` (shared by all executors)."""
        return Run(self, spark, folder, notify)


class Run:
    """Phases one after the other, each written as Parquet and read again by the next: lineage ends there, and a run that was
    cancelled or failed goes on behind the last whole phase. ``state.json`` says what is done, with rows and seconds of each phase.

    Jobs carry a tag of the run, so ``cancel`` (from any thread) ends those of this run alone."""

    def __init__(self, pipeline: Pipeline, spark: SparkSession, folder: str, notify: Callable[[str, float], None] | None = None):
        self.pipeline, self.spark, self.folder, self.notify = pipeline, spark, folder.rstrip("/"), notify
        self.tag = f"leafmill-{abs(hash(self.folder)):x}"
        self._stop, self._idle = threading.Event(), threading.Event()
        self._idle.set()

    @property
    def names(self) -> list[str]:
        p = self.pipeline
        return [n for n in p.phases if p.enabled is None or n in p.enabled]

    @property
    def state(self) -> dict:
        text = store.read_text(self.spark, f"{self.folder}/state.json")
        return json.loads(text) if text else {"status": "new", "phases": {}}

    @property
    def progress(self) -> float:
        """Hundredths of the phases that are written."""
        return 100 * sum(n in self.state["phases"] for n in self.names) / len(self.names) if self.names else 100.0

    def _path(self, name: str) -> str:
        return f"{self.folder}/{self.names.index(name):02d}-{name}"

    def _save(self, status: str, phases: dict) -> None:
        store.write_text(self.spark, f"{self.folder}/state.json", json.dumps({"status": status, "names": self.names, "phases": phases}))

    def cancel(self) -> None:
        """End the run's jobs, also those that it begins while this is asked, and return when it has ended."""
        self._stop.set()
        while not self._idle.is_set():
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._idle.wait(0.2)

    def execute(self, table: DataFrame) -> DataFrame:
        """The last phase's table. Phases that an earlier run has written are read, if the phases before them are the same."""
        before = self.state
        old = before["phases"] if before.get("names", self.names)[: len(before["phases"])] == self.names[: len(before["phases"])] else {}
        phases: dict = {}
        self._stop.clear()
        self._idle.clear()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            for name in self.names:
                path = self._path(name)
                if name in old and store.exists(self.spark, f"{path}/_SUCCESS"):
                    phases[name] = old.pop(name)
                    table = self.spark.read.parquet(path)
                    continue
                old = {}
                if self._stop.is_set():
                    self._save("cancelled", phases)
                    raise Cancelled("PIPELINE_FAILED", name, "cancelled", done=list(phases))
                self._save("running", phases)
                began, seen = time.monotonic(), Observation(f"{name}-rows")
                try:
                    made = table.transform(self.pipeline.phases[name])
                    made.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
                except Exception as e:
                    stopped = self._stop.is_set()
                    self._save("cancelled" if stopped else "failed", phases)
                    kind, code = (Cancelled, "PIPELINE_FAILED") if stopped else (PipelineError, PHASE_CODES.get(name, "PIPELINE_FAILED"))
                    raise kind(code, name, str(e), done=list(phases), seconds=round(time.monotonic() - began, 3)) from e
                phases[name] = {"rows": seen.get["rows"], "seconds": round(time.monotonic() - began, 3)}
                self._save("running", phases)
                table = self.spark.read.schema(made.schema).parquet(path)
                log.info("phase %s: %s", name, phases[name])
                if self.notify:
                    self.notify(name, self.progress)
            self._save("completed", phases)
        finally:
            context.removeJobTag(self.tag)
            self._idle.set()
        return table

    def clean_up(self, keep: bool = False) -> bool:
        """Delete what the phases wrote, but not the state: only of a run that is completed, whose last phase is whole. Call it when the result
        is where it belongs. Returns whether it deleted anything."""
        names = self.names
        if keep or self.state["status"] != "completed" or not names or not store.exists(self.spark, f"{self._path(names[-1])}/_SUCCESS"):
            return False
        return any([store.delete(self.spark, self._path(n)) for n in names])


def detect(files: DataFrame, pdf: Callable[..., tuple[int, str]] | None = None) -> DataFrame:
    """Files (path, length, content) with format, mime, confidence, is_valid, issues (an array) and config_key. Invalid files go on.

    pdf: an extractor, called as ``pdf(content, 5)``; with it PDFs are validated by their first five pages, and page_count, pdf_version, content_type,
    coverage, image_count and image_pages are columns too (null of other files). One that it fails on is empty and invalid."""
    c, p = F.col("content"), F.col("path")
    out = files.withColumn("magic", N.magic_format(c)).withColumn("by_name", N.extension_format(p))
    out = out.withColumn("format", F.coalesce("magic", "by_name"))
    big = N.exceeds_limit(F.col("format"), F.col("length"))
    valid, more = (F.col("format") == "pdf") & ~big, F.array().cast("array<string>")
    if pdf is not None:
        parsed = pdf_text(out.where("format = 'pdf'"), pdf, 5).withColumnRenamed("text", "_sample").withColumnRenamed("issue", "_failed")
        out = out.join(parsed, "path", "left")
        is_pdf, pages = F.col("format") == "pdf", F.coalesce("page_count", F.lit(0))
        parts = N.pdf_parts(pages, F.coalesce("_sample", F.lit("")), N.image_matches(c))
        out = out.withColumn("_parts", F.when(is_pdf & F.col("_failed").isNull(), parts))
        more = F.when(F.col("_failed").isNotNull(), F.array(F.concat(F.lit("PDF parsing failed: "), F.col("_failed")))).otherwise(F.coalesce(F.col("_parts.issues"), more))
        valid = valid & F.coalesce((pages > 0) & F.col("_failed").isNull(), F.lit(False))
        none, failed = F.array().cast("array<int>"), F.col("_failed").isNotNull()
        out = out.withColumn("page_count", F.when(is_pdf, pages)).withColumn("pdf_version", F.when(is_pdf, F.when(failed, "unknown").otherwise(N.pdf_version(c))))
        out = out.withColumn("content_type", F.when(failed, "empty").otherwise(F.col("_parts.content_type"))).withColumn("coverage", F.when(failed, 0.0).otherwise(F.col("_parts.coverage")))
        out = out.withColumn("image_count", F.when(failed, F.lit(0).cast("long")).otherwise(F.col("_parts.image_count"))).withColumn("image_pages", F.when(failed, none).otherwise(F.col("_parts.image_pages")))
    conf = N.format_confidence(F.coalesce("magic", "by_name"), F.col("by_name"), N.magic_confidence(c), valid)
    out = out.withColumn("issues", F.concat(N.format_issues(F.col("format"), F.col("magic"), F.col("by_name"), big), more)).withColumn("mime", N.mime_type(F.col("format")))
    return out.withColumn("is_valid", valid).withColumn("confidence", conf).withColumn("config_key", N.config_key(N.name_parts(p))).drop("magic", "by_name", "_sample", "_failed", "_parts")


def extract(manifests: DataFrame | None = None, pdf: Callable[..., tuple[int, str]] | None = None) -> Phase:
    """Text of files, cut at the markers of their manifest if they have one. PDFs are read whole by the extractor, if there is
    one and they are valid; a PDF that gives nothing has an empty text."""

    def run(files: DataFrame) -> DataFrame:
        text = F.decode("content", "UTF-8")
        if pdf is not None:
            found = pdf_text(files.where("format = 'pdf' and is_valid"), pdf).select("path", F.col("text").alias("_pdf"))
            files = files.join(found, "path", "left")
            text = F.when(F.col("format") == "pdf", F.coalesce("_pdf", F.lit(""))).otherwise(text)
        if manifests is None:
            return files.withColumn("text", text).drop("_pdf")
        marks = manifests.select("config_key", "text_before", "text_after")
        cut = boundary_slice(text, F.col("text_before"), F.col("text_after"))
        return files.join(marks, "config_key", "left").withColumn("text", cut).drop("text_before", "text_after", "_pdf")

    return run


def recognise(pages: DataFrame, levels: list[list[dict]], offsets: dict | None, kind: str = "", removals: tuple[str, ...] = ()) -> Phase:
    """ocr_text of books that have recognised pages (config_key, page_no, lines): headings and footnotes by layout (noise is cleared
    where lines are matched with headings), pages joined, misread words mended, patterns of the kind of book removed. Books without pages have none."""

    def run(books: DataFrame) -> DataFrame:
        made = assemble_books(structure_pages(pages, levels, offsets, kind, "config_key"), "config_key")
        text = remove_patterns(fix_umlauts(F.col("text")), valid_patterns(books.sparkSession, list(removals)))
        return books.join(made.select("config_key", text.alias("ocr_text")), "config_key", "left")

    return run


def clean(options: CleanOptions = CleanOptions()) -> Phase:
    """cleaned_text and stats; where texts were recognised too, cleaned_ocr of these, by the rules for recognised text."""

    def run(texts: DataFrame) -> DataFrame:
        out = clean_text(texts, options)
        if "ocr_text" not in texts.columns:
            return out
        ocr = clean_text(out.withColumnsRenamed({"cleaned_text": "_text", "stats": "_stats"}), replace(options, source="ocr"), "ocr_text")
        cleaned = F.when(F.col("ocr_text").isNotNull(), F.col("cleaned_text")).alias("cleaned_ocr")
        return ocr.select(*texts.columns, F.col("_text").alias("cleaned_text"), F.col("_stats").alias("stats"), cleaned)

    return run


def manifest(folder: str) -> Phase:
    """Outline and footnotes of recognised books (else of extracted ones) in their manifest files; manifest_changed says where one was written."""

    def run(books: DataFrame) -> DataFrame:
        text = F.coalesce("ocr_text", "text") if "ocr_text" in books.columns else F.col("text")
        changes = from_books(books.where("config_key is not null").select("config_key", text.alias("text")))
        done = update_all(books.sparkSession, folder, changes).select("config_key", F.col("changed").alias("manifest_changed"))
        return books.join(done, "config_key", "left")

    return run


def markdown(folder: str) -> Phase:
    """One Markdown file for each book, of the best text that it has (cleaned before raw, recognised before extracted): name and path."""

    def run(books: DataFrame) -> DataFrame:
        texts = [c for c in ("cleaned_ocr", "cleaned_text", "ocr_text", "text") if c in books.columns]
        return write_markdown(books.select(F.col("config_key").alias("name"), F.coalesce(*texts).alias("text")), folder)

    return run


def book_pipeline(manifests: DataFrame | None = None, options: CleanOptions = CleanOptions(), markdown_folder: str | None = None, pdf: Callable[..., tuple[int, str]] | None = None, recognised: Phase | None = None, manifest_folder: str | None = None) -> Pipeline:
    """Detection, extraction and cleaning; recognised pages (a phase of recognise) between these if there are some. With folders (URIs that
    executors share), outlines go into manifest files and texts into Markdown files at the end."""
    steps = Pipeline().add("detect", lambda files: detect(files, pdf)).add("extract", extract(manifests, pdf))
    if recognised:
        steps.add("recognise", recognised)
    if manifest_folder:
        steps.add("manifest", manifest(manifest_folder))
    steps.add("clean", clean(options))
    return steps.add("markdown", markdown(markdown_folder)) if markdown_folder else steps
