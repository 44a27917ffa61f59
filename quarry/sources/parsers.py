"""File formats to text. One map over binaryFile rows; a file that can't be read becomes a row with its reason."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.functions import fixed

SUPPORTED = fixed.TEXT_SUFFIXES + fixed.PDF_SUFFIXES + fixed.DOCX_SUFFIXES + fixed.SHEET_SUFFIXES + fixed.CSV_SUFFIXES + fixed.IMAGE_SUFFIXES
PARSED = "path string, text string, kind string, pages int, warning string, error string"
SCANNED = "PDF sem texto embutido (provavelmente digitalizado); o conteudo veio de OCR e pode conter erros de leitura"
OCR = "o conteudo veio de OCR e pode conter erros de leitura"


class Unreadable(RuntimeError):
    """No parser for this format here."""


def suffix(path: str) -> str:
    return posixpath.splitext(path)[1].lower()


def delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def rows_to_sentences(rows: list) -> list[str]:
    """'header: value' of the filled cells of each row after the first; cells beyond the header and empty rows go."""
    if not rows:
        return []
    header = ["" if c is None else str(c).strip() for c in rows[0]]
    names = [h or f"coluna {i}" for i, h in enumerate(header, 1)]
    made = ("; ".join(f"{n}: {v}" for n, v in zip(names, row) if v is not None and str(v).strip()) for row in rows[1:])
    return [s for s in made if s]


def parse_csv(body: bytes, ext: str) -> str:
    text = body.decode("utf-8", "replace")
    mark = "\t" if ext == ".tsv" else delimiter(text)
    return "\n".join(rows_to_sentences(list(csv.reader(io.StringIO(text), delimiter=mark))))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_docx(body: bytes) -> str:
    """Paragraphs, headings as the chunker's marks, then the tables' rows. The format is XML in a zip."""
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    main = root.find(f"{_W}body")
    for p in main.findall(f"{_W}p"):
        if not (text := words(p)):
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        named = style.get(f"{_W}val") if style is not None else ""
        named = (styles.get(named) or named or "").lower()
        if named.startswith(("heading", "titulo", "título")):
            marks = "=" * (min(int("".join(filter(str.isdigit, named)) or 1), 4) + 1)
            text = f"\n{marks} {text} {marks}\n"
        out.append(text)
    for row in main.iter(f"{_W}tr"):
        if cells := [t for t in map(words, row.findall(f"{_W}tc")) if t]:
            out.append(" | ".join(cells))
    return "\n\n".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_sheet(body: bytes) -> str:
    """Sheets as sections of sentences, with stored values."""
    out = []
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = rels[sheet.get(f"{_R}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: dict[int, object] = {}
                for i, c in enumerate(row.findall(f"{_S}c")):
                    value, kind = c.find(f"{_S}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else value.text if value is not None else None
                    cells[_column(c.get("r")) if c.get("r") else i] = shared[int(text)] if kind == "s" and text is not None else text
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            if rows:
                out += [f"\n== {sheet.get('name')} ==\n", *rows_to_sentences(rows)]
    return "\n".join(out)


def parse_pdf(body: bytes, ocr=None) -> tuple[str, str, int, str | None]:
    try:
        import pymupdf
        import pymupdf4llm
    except ImportError as e:
        raise Unreadable("PDF needs the optional packages pymupdf and pymupdf4llm") from e
    with pymupdf.open(stream=body, filetype="pdf") as opened:
        pages, text = opened.page_count, pymupdf4llm.to_markdown(opened, show_progress=False)
    if pages and ocr and len(text.strip()) < pages * fixed.MIN_CHARS_PER_PAGE:
        seen = ocr(body, ".pdf") or ""
        if len(seen.strip()) > len(text.strip()):
            return seen, "pdf-ocr", pages, SCANNED
    return text, "pdf", pages, None


def parse(path: str, body: bytes, ocr=None) -> tuple[str, str, int | None, str | None]:
    """(text, kind, pages, warning). ocr: a provider (body, suffix) -> text."""
    ext = suffix(path)
    if ext in fixed.TEXT_SUFFIXES:
        return body.decode("utf-8", "replace"), "texto", None, None
    if ext in fixed.CSV_SUFFIXES:
        return parse_csv(body, ext), "planilha", None, None
    if ext in fixed.SHEET_SUFFIXES:
        return parse_sheet(body), "planilha", None, None
    if ext in fixed.DOCX_SUFFIXES:
        return parse_docx(body), "docx", None, None
    if ext in fixed.PDF_SUFFIXES:
        return parse_pdf(body, ocr)
    if ext in fixed.IMAGE_SUFFIXES:
        if ocr is None:
            raise Unreadable("images need an OCR provider")
        return ocr(body, ext), "ocr", None, OCR
    raise Unreadable(f"extensao {ext!r} nao suportada")


def parse_files(files: DataFrame, ocr=None) -> DataFrame:
    """files: path, content (binaryFile). Failures are rows with an error, not exceptions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    text, kind, pages, warning = parse(path, body or b"", ocr)
                    rows.append((path, text, kind, pages, warning, None if text.strip() else "nenhum texto extraido"))
                except Unreadable as e:
                    rows.append((path, None, None, None, None, str(e)))
                except Exception as e:  # a broken file is its own row's failure
                    rows.append((path, None, None, None, None, f"nao foi possivel ler: {type(e).__name__}"))
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PARSED.split(", ")])

    return files.select("path", "content").mapInArrow(run, PARSED)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder as binaryFile rows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
