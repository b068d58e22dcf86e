"""Page records of PDF files through a page reader, with text recognition where a page has none.

A reader is a provider: ``pages(content)`` gives a dict per page (text, drawings, images, widgets, words, cells). The default
uses PyMuPDF if it can be imported. Recognition is a provider too; without one its status says that it is unavailable.
Defined results: a file that can't be read is one row without pages, type ``other``, confidence 0 and the error; null contents count
as such; nothing is raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

#: Below so many characters a page needs more than its text; above so many drawings its letters are drawn.
FEW_CHARS, MANY_DRAWINGS = 30, 20
#: How the status of a page is called in coverage reports.
STATUS_NAMES = {"blank": "blank", "vector_outlines": "non-extractable (vector outlines)", "scanned": "scanned (image)", "form_widgets": "form_widgets_only", "extractable": "extractable"}
UNAVAILABLE = ("", "tesseract_and_vision_unavailable")
WIDGET = "array<struct<name:string,value:string,type:string>>"
SCHEMA = f"path string, page_number int, text string, status string, char_count int, raw_char_count int, drawings int, images int, widgets {WIDGET}, is_scanned boolean, is_blank boolean, has_vector_outlines boolean, ocr_attempted boolean, ocr_status string, doc_type string, doc_type_confidence double, error string"


class PageReader(Protocol):
    def pages(self, content: bytes) -> list[dict]: ...


class Recognizer(Protocol):
    def recognize(self, page: dict) -> tuple[str, str]: ...


class LibraryReader:
    """Pages by PyMuPDF."""

    def pages(self, content: bytes) -> list[dict]:
        import pymupdf

        out = []
        with pymupdf.open(stream=content, filetype="pdf") as doc:
            for page in doc:
                widgets = [{"name": w.field_name, "value": w.field_value or "", "type": w.field_type_string} for w in page.widgets()]
                out.append({"text": page.get_text("text"), "drawings": len(page.get_drawings()), "images": len(page.get_images()), "widgets": widgets, "image": page.get_pixmap(dpi=150).tobytes("png")})
        return out


class NoRecognizer:
    def recognize(self, page: dict) -> tuple[str, str]:
        return UNAVAILABLE


def read_page(page: dict, recognizer: Recognizer) -> dict:
    """One page's record: its status decides whether form values or recognised text stand in for its own."""
    text = page.get("text") or ""
    raw, drawings, images, widgets = len(text.strip()), page.get("drawings", 0), page.get("images", 0), page.get("widgets") or []
    status, ocr, attempted = "extractable", "none", False
    if raw < FEW_CHARS and drawings > MANY_DRAWINGS:
        status = "vector_outlines"
        if widgets:
            filled = [f"- **{w['name']}**: {str(w['value']).strip()}" for w in widgets if str(w.get("value") or "").strip()]
            text = "\n".join([f"### Form Fields (Page {page.get('page_number', 1)})", *filled]) if filled else ""
        seen, ocr = recognizer.recognize(page)
        attempted, text = True, (text + "\n\n" + seen).strip() if seen else text
    elif raw == 0 and not images and not widgets:
        status = "blank"
    elif raw < FEW_CHARS:
        status, attempted = "scanned", True
        seen, ocr = recognizer.recognize(page)
        text = seen or text
    elif widgets and raw < FEW_CHARS:
        status = "form_widgets"
    return {"text": text, "status": STATUS_NAMES[status], "char_count": len(text.strip()), "raw_char_count": raw, "drawings": drawings, "images": images, "widgets": widgets, "is_scanned": status == "scanned", "is_blank": status == "blank", "has_vector_outlines": status == "vector_outlines", "ocr_attempted": attempted, "ocr_status": ocr}


def read_pdfs(files: DataFrame, make_reader: Callable[[], PageReader] = LibraryReader, make_recognizer: Callable[[], Recognizer] = NoRecognizer) -> DataFrame:
    """A row per page of the files (path, content); a reader is made once per worker."""
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, recognizer = make_reader(), make_recognizer()
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                try:
                    for n, page in enumerate(reader.pages(content), 1):
                        rows.append({"path": path, "page_number": n, **read_page({**page, "page_number": n}, recognizer), "doc_type": None, "doc_type_confidence": None, "error": None})
                except Exception as e:  # noqa: BLE001
                    rows = [dict.fromkeys(columns) | {"path": path, "doc_type": "other", "doc_type_confidence": 0.0, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
