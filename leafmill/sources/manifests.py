"""Manifests and kinds of books. Manifests are read, merged and written by tasks; the driver handles single ones."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.structure import FOOTNOTES, footnote_list, outline
from leafmill.sources.store import qualified, read_text, write_file

NAME = "book-manifest.yaml"
#: The folder of the manifest that new ones are made from.
TEMPLATE = "default"
FIELDS = ("config_key", "author", "title", "book_index", "text_before", "text_after", "file_type", "page_count", "size", "structure", "footnotes")
DEFAULT = {"author": "", "title": "", "book_index": None, "text_before": "", "text_after": "", "file_type": "text", "page_count": 0, "size": 0, "structure": [], "footnotes": []}
SCHEMA = "config_key string, author string, title string, book_index string, text_before string, text_after string, file_type string, page_count long, size long, structure array<string>, footnotes array<string>"
#: A field's place in the file.
PLACES = {"author": ("author",), "title": ("title",), "book_index": ("book-index",), "text_before": ("text-before-first-chapter",), "text_after": ("text-after-last-chapter",), "file_type": ("original", "format"), "size": ("original", "size"), "page_count": ("original", "pages"), "structure": ("book-structure",), "footnotes": ("footnotes",)}
#: Bytes of manifests up to which a join broadcasts them.
BROADCAST_BYTES = 64 << 20


def parse(text: str) -> dict:
    """YAML where its library is there (its C parser, if built, reads the same in a tenth of the time); JSON, which YAML includes, always."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}


def dump(document: dict) -> str:
    try:
        import yaml
    except ImportError:
        return json.dumps(document, ensure_ascii=False, indent=2)
    return yaml.dump(document, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), allow_unicode=True, sort_keys=False, width=120)


def fields_of(document: dict) -> dict:
    """A file's fields by name; what isn't there has its default. Files that name fields directly are read too."""
    out = dict(DEFAULT)
    for name, (first, *rest) in PLACES.items():
        value = document.get(first)
        if rest:
            value = value.get(rest[0]) if isinstance(value, dict) else None
        value = document.get(name) if value is None else value
        if value is not None:
            out[name] = value
    return out


def merged(document: dict, values: dict) -> dict:
    """The file's document with new values in their places; what it holds besides stays."""
    out = {k: v for k, v in document.items() if k not in values}
    for name, value in values.items():
        if name not in PLACES:
            continue
        first, *rest = PLACES[name]
        if rest:
            inner = out.get(first)
            out[first] = {**(inner if isinstance(inner, dict) else {}), rest[0]: value}
        elif value is None:
            out.pop(first, None)
        else:
            out[first] = value
    return out


def _read(path: Path) -> dict:
    return parse(path.read_text(encoding="utf-8"))


def path_of(folder: str, key: str) -> Path:
    """One place for saving, loading, updating and asking."""
    return Path(folder) / key / NAME


def exists(folder: str, key: str) -> bool:
    return path_of(folder, key).exists()


def load(folder: str, key: str) -> dict:
    return {"config_key": key} | fields_of(_read(path_of(folder, key)))


def save(folder: str, key: str, manifest: dict) -> None:
    from pyarrow.fs import LocalFileSystem

    path = path_of(folder, key)
    path.parent.mkdir(parents=True, exist_ok=True)
    document = _read(path) if path.exists() else {}
    write_file(LocalFileSystem(), str(path), dump(merged(document, {k: v for k, v in manifest.items() if k != "config_key"})).encode())


def named(key: str) -> dict:
    """What a key says: author, title and index."""
    author, title, *index = key.split("#")
    return {"author": author, "title": title, "book_index": index[0] if index else None}


def create(folder: str, key: str, **values) -> dict:
    """A new manifest from the default one, if there is one, else from defaults."""
    default = path_of(folder, TEMPLATE)
    manifest = (fields_of(_read(default)) if default.exists() else DEFAULT) | named(key) | values
    save(folder, key, manifest)
    return {"config_key": key} | manifest


def update(folder: str, key: str, **values) -> dict:
    manifest = load(folder, key) | values
    save(folder, key, manifest)
    return manifest


def available(folder: str) -> list[str]:
    return sorted(p.parent.name for p in Path(folder).glob(f"*/{NAME}") if p.parent.name != TEMPLATE)


def _uri(spark: SparkSession, folder: str) -> str:
    """A folder's URI for pyarrow, to which a local one is a plain path: no sign in it is decoded."""
    uri = qualified(spark, folder)
    return f"/{uri[5:].lstrip('/')}" if uri.startswith("file:") else uri


def _tasks(spark: SparkSession) -> int:
    """Tasks that open or write a file for each row: rows are few bytes, so their size says nothing of the work."""
    return spark.sparkContext.defaultParallelism * 4


def _below(spark: SparkSession, folder: str) -> DataFrame:
    """place: the folders right below ``folder``, and ``folder`` itself if it holds a manifest. One task asks for these names, once; nothing else
    is listed, and nothing by the driver, whose local file system would start a process for each file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for _ in parts:
            found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
            for i in range(0, len(found), 10_000):
                some = found[i : i + 10_000]
                yield pd.DataFrame({"place": [x.path for x in some if x.type == fs.FileType.Directory] + [base for x in some if x.base_name == NAME and x.type == fs.FileType.File]}, dtype=object)

    return spark.range(0, 1, 1, 1).mapInPandas(run, "place string")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """config_key, content of all manifest files but the default one, found and read by tasks. The key is the name of the file's folder."""
    folder = _uri(spark, folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for p in parts:
            for i in range(0, len(p), 1000):
                rows = []
                for place in p["place"].iloc[i : i + 1000]:
                    for x in store.get_file_info(fs.FileSelector(place, recursive=place != base)):
                        key = x.path.split("/")[-2]
                        if x.base_name == NAME and x.type == fs.FileType.File and key != TEMPLATE:
                            with store.open_input_stream(x.path) as f:
                                rows.append((key, f.read()))
                yield pd.DataFrame(rows, columns=["config_key", "content"])

    return _below(spark, folder).repartition(_tasks(spark), "place").mapInPandas(run, "config_key string, content binary")


def table(spark: SparkSession, folder: str) -> DataFrame:
    """All manifests (SCHEMA and issue), parsed by tasks. One that can't be read has defaults, and why in ``issue``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for key, content in zip(p["config_key"], p["content"], strict=True):
                try:
                    found, issue = fields_of(parse(bytes(content).decode())), None
                    found = found | {"page_count": int(found["page_count"]), "size": int(found["size"]), "book_index": None if found["book_index"] is None else str(found["book_index"])}
                    found |= {k: [str(x) for x in found[k] or []] for k in ("structure", "footnotes")}
                except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                    found, issue = DEFAULT, f"{type(e).__name__}: {e}"
                rows.append((key, *(found[f] for f in FIELDS[1:]), issue))
            yield pd.DataFrame(rows, columns=[*FIELDS, "issue"])

    return documents(spark, folder).mapInPandas(run, f"{SCHEMA}, issue string")


class Manifests:
    """The table of a folder, read once: kept in executors' memory and disk until it is cleared."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._table: DataFrame | None = None

    def get(self) -> DataFrame:
        if self._table is None:
            self._table = table(self.spark, self.folder).persist()
        return self._table

    def clear(self) -> None:
        if self._table is not None:
            self._table.unpersist()
        self._table = None


def with_manifests(books: DataFrame, manifests: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """books with the manifest's fields (nulls where there is none). The manifests' size is measured, and they are broadcast up to ``limit``
    bytes; beyond, both sides are dealt by key."""
    text = [c for c, t in manifests.dtypes if t == "string"]
    lists = [c for c, t in manifests.dtypes if t == "array<string>"]
    size = sum((F.octet_length(F.coalesce(F.col(c), F.lit(""))) for c in text), F.lit(64)) + sum((F.octet_length(F.coalesce(F.array_join(c, ""), F.lit(""))) for c in lists), F.lit(0))
    total = manifests.agg(F.sum(size.cast("long"))).first()[0] or 0
    return books.join(F.broadcast(manifests) if total <= limit else manifests, "config_key", "left")


def update_all(spark: SparkSession, folder: str, changes: DataFrame) -> DataFrame:
    """Merge ``changes`` (config_key and any fields; null leaves a field as it is) into the files below ``folder``, a URI that executors share;
    files that aren't there yet are made, from the default one where there is one. Returns config_key, path, whether the file changed, and an issue where an older file can't be
    read; that one stays as it is.

    A task opens the file of each of its keys, merges the new values and writes whole files, so it may run again: merging is the same the second
    time. Nothing is listed and no content is shuffled. A key's rows should be one; of several any one holds."""
    fields = [f for f in FIELDS[1:] if f in changes.columns]
    template = parse(read_text(spark, f"{folder}/{TEMPLATE}/{NAME}") or "{}")
    folder = _uri(spark, folder)
    dealt = changes.select("config_key", *fields).repartition(_tasks(spark), "config_key").dropDuplicates(["config_key"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                values = {f: [str(x) for x in v] if f in ("structure", "footnotes") else int(v) if f in ("size", "page_count") else v for f in fields if (v := r[f]) is not None and not (isinstance(v, float) and v != v)}
                place = f"{base}/{r['config_key']}"
                try:
                    document = {}
                    if store.get_file_info(f"{place}/{NAME}").type == fs.FileType.File:
                        with store.open_input_stream(f"{place}/{NAME}") as f:
                            document = parse(f.read().decode())
                    if not isinstance(document, dict):
                        raise ValueError("no mapping of fields")
                except Exception as e:  # noqa: BLE001  a file that can't be read stays as it is
                    rows.append((r["config_key"], f"{place}/{NAME}", False, f"{type(e).__name__}: {e}"))
                    continue
                if not document:
                    document = template
                    values = {k: v for k, v in named(r["config_key"]).items() if v is not None} | values
                store.create_dir(place, recursive=True)
                rows.append((r["config_key"], f"{place}/{NAME}", write_file(store, f"{place}/{NAME}", dump(merged(document, values)).encode()), None))
            yield pd.DataFrame(rows, columns=["config_key", "path", "changed", "issue"])

    usable = dealt.where("config_key <> '' and not contains(config_key, '/') and config_key not in ('.', '..')")
    return usable.mapInPandas(run, "config_key string, path string, changed boolean, issue string")


def from_books(books: DataFrame) -> DataFrame:
    """Changes for update_all from assembled books (config_key, text): their outline, and the notes below their heading."""
    notes = F.when(F.contains("text", F.lit(FOOTNOTES)), F.substring_index("text", FOOTNOTES, -1)).otherwise("")
    return books.select("config_key", outline(F.col("text")).alias("structure"), footnote_list(notes).alias("footnotes"))


def drift(books: DataFrame, manifests: DataFrame) -> DataFrame:
    """Books whose file type, size or page count isn't that of their manifest: config_key and the fields that differ.

    Manifests are few and small, one row a book, so Spark broadcasts them where that holds."""
    m = manifests.select("config_key", *(F.col(c).alias(f"_{c}") for c in ("file_type", "size", "page_count")))
    differs = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("file_type", "size", "page_count"))), lambda x: x.isNotNull())
    return books.join(m, "config_key").select("config_key", differs.alias("differs")).where(F.size("differs") > 0)


def book_types(path: str) -> dict | None:
    """Kinds of books by name, or None where there is no such file. Keys may be written with hyphens or in camel case."""
    p = Path(path)
    if not p.exists():
        return None
    import re

    fix = lambda x: {re.sub(r"(?<=[a-z0-9])([A-Z])", r"-\1", k).lower(): fix(v) for k, v in x.items()} if isinstance(x, dict) else [fix(v) for v in x] if isinstance(x, list) else x
    return fix(_read(p))


def removal_patterns(types: dict, kind: str | None) -> list[str]:
    """Patterns of a known kind, else those of all kinds but the default, each once, in order."""
    if kind and kind in types:
        return list(types[kind].get("text-removal-patterns") or [])
    return list(dict.fromkeys(p for k, t in types.items() if k != "default" for p in t.get("text-removal-patterns") or []))


def header_types(types: dict, kind: str | None) -> dict:
    """Heading formats of a kind, else of the default."""
    return (types.get(kind or "") or types.get("default") or {}).get("header-types") or {}
