"""Documents from files: text, markup, office and book formats, found recursively and told by their suffix."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from setaccio.functions.udf import SKIPPED, SKIPPED_IN_BOOKS, html_text

_BOOK_SKIPPED = frozenset(("script", "style", "nav"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _text_of(element: ElementTree.Element, run: str, breaks: frozenset[str] = frozenset(("br", "cr"))) -> str:
    return "".join((e.text or "") if _local(e.tag) == run else "\t" if _local(e.tag) == "tab" else "\n" if _local(e.tag) in breaks else "" for e in element.iter())


def text_bytes(data: bytes) -> str:
    """UTF-8 with a replacement character for each byte that isn't."""
    return data.decode("utf-8", "replace")


def word_document(data: bytes) -> str:
    """The paragraphs that aren't blank, a line each."""
    root = ElementTree.fromstring(_parts(data).read("word/document.xml"))
    paragraphs = [_text_of(p, "t") for p in root.iter() if _local(p.tag) == "p"]
    return "\n".join(p for p in paragraphs if p.strip())


def slides(data: bytes) -> str:
    """The texts of shapes that aren't blank, slide by slide, a line each."""
    parts = _parts(data)
    names = sorted((n for n in parts.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for name in names:
        for body in ElementTree.fromstring(parts.read(name)).iter():
            if _local(body.tag) == "txBody":
                out.append("\n".join(_text_of(p, "t") for p in body if _local(p.tag) == "p"))
    return "\n".join(t for t in out if t.strip())


def open_document(data: bytes) -> str:
    """The text directly inside paragraphs, a line each; text inside spans isn't read, as the rule has it."""
    root = ElementTree.fromstring(_parts(data).read("content.xml"))
    texts = ["".join([p.text or "", *((c.tail or "") for c in p)]) for p in root.iter() if _local(p.tag) == "p"]
    return "\n".join(t for t in texts if t.strip())


def chapters(data: bytes) -> Iterator[str]:
    """The markup of a book's documents in reading order, or by name where the order isn't given."""
    parts = _parts(data)
    names = [n for n in parts.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    order = sorted(names)
    try:
        package = next(e.get("full-path") for e in ElementTree.fromstring(parts.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
        root = ElementTree.fromstring(parts.read(package))
        items = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), e.get("href"))) for e in root.iter() if _local(e.tag) == "item"}
        spine = [items.get(e.get("idref")) for e in root.iter() if _local(e.tag) == "itemref"]
        order = [n for n in spine if n in names] or order
    except (KeyError, StopIteration, ElementTree.ParseError):
        pass
    for n in order:
        yield text_bytes(parts.read(n))


def book(data: bytes) -> str:
    """A book's documents without scripts, styles and navigation, an empty line between them."""
    return "\n\n".join(t for t in (html_text(c, _BOOK_SKIPPED) for c in chapters(data)) if t and t.strip())


def clean_book(data: bytes) -> str:
    """A book's documents without notes, figures and the like, lines stripped and blank ones collapsed to one."""
    out = []
    for c in chapters(data):
        lines = [line.strip() for line in (html_text(c, SKIPPED_IN_BOOKS) or "").split("\n")]
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
        if text:
            out.append(text)
    return "\n\n".join(out)


def page(data: bytes) -> str:
    return html_text(data, SKIPPED)


def portable_document(data: bytes) -> str:
    try:
        from pdfminer.high_level import extract_text
    except ImportError as e:
        raise RuntimeError("reading PDF needs pdfminer, which isn't installed") from e
    return extract_text(io.BytesIO(data))


#: Extractor of each suffix; add to it to read another format.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    ".txt": text_bytes, ".md": text_bytes, ".pdf": portable_document, ".docx": word_document, ".doc": word_document, ".pptx": slides, ".ppt": slides,
    ".epub": book, ".html": page, ".htm": page, ".odt": open_document,
}


def suffixes(names: str) -> list[str]:
    """`a,.B` as ['.a', '.b']."""
    return ["." + n.strip().lower().lstrip(".") for n in names.split(",") if n.strip()]


def read_files(spark: SparkSession, paths: str | list[str], only: str | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, text, error of every file under the paths; error names what kept a file from being read, and its text is null.

    Files of a suffix without an extractor have the error `unknown format`. With `only` (as suffixes() takes it) others aren't listed.
    """
    known = dict(extractors or EXTRACTORS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = files.select("path", "content", suffix.alias("suffix"))
    if only:
        files = files.where(F.col("suffix").isin(*suffixes(only)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for kind, content in zip(b["suffix"], b["content"]):
                try:
                    texts.append(known[kind](content) if kind in known else None)
                    errors.append(None if kind in known else "unknown format")
                except Exception as e:  # one broken file doesn't end the scan
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield pd.DataFrame({"path": b["path"], "text": texts, "error": errors})

    return files.mapInPandas(run, "path string, text string, error string")
