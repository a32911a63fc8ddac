"""Word documents and images, and the dispatch from files to contents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from caseloom.constants import MEDIA_TYPES, TEXT_EXTENSIONS
from caseloom.frames import byte_sizes, runs
from caseloom.functions.text import strip_html, strip_text
from caseloom.operators.combine import assemble_pages
from caseloom.sources.emails import decode_email

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# What the break elements of a run stand for in text.
_BREAKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def _paragraphs(content: bytes) -> list[str]:
    """Non-empty body paragraphs; tables, headers and footers are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts, parts.open("word/document.xml") as xml:
        body = ElementTree.parse(xml).getroot().find(f"{_W}body")
    found = []
    for paragraph in body.findall(f"{_W}p") if body is not None else []:
        runs = [r for child in paragraph for r in ([child] if child.tag == f"{_W}r" else
                child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else [])]
        pieces = [(e.text or "") if e.tag == f"{_W}t" else _BREAKS.get(e.tag, "") for r in runs for e in r]
        found.append("".join(pieces))
    return [p for p in found if p]


def decode_docx(content: bytes) -> tuple[str, str]:
    try:
        return "text/plain", "\n".join(_paragraphs(content))
    except Exception:
        return "none", ""


_DECODERS = {"docx": decode_docx, "eml": decode_email}


@arrow_udf(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))
def _decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for reader, content in batches:
        for start, stop in runs(byte_sizes([content])):
            found = []
            for r, c in zip(reader[start:stop].to_pylist(), content[start:stop], strict=True):
                found.append(_DECODERS[r](c.as_py()) if r in _DECODERS and c.is_valid else (None, None))
            kinds, texts = zip(*found, strict=True)
            yield pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["type", "text"])


def document_text(reader: Column, content: Column) -> Column:
    """Text of a Word file (``docx``: paragraphs joined by line ends) or an email (``eml``: the plain
    body, else the HTML body without tags); '' where nothing can be read, NULL for other readers.

    Workers only decode, and get the bytes of these two kinds only; stripping is Spark's.
    """
    decoded = _decode(reader, F.when(reader.isin(list(_DECODERS)), content))
    text = decoded["text"]
    clean = F.when(decoded["type"] == "text/html", strip_html(text)).otherwise(strip_text(text))
    return F.when(reader.isin(list(_DECODERS)), F.coalesce(clean, F.lit("")))


def media_type(ext: Column) -> Column:
    """Media type of an image extension; NULL for others."""
    types = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(types, ext)


def image_base64(content: Column) -> Column:
    """Base64 without the line breaks that Spark's function puts in."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def file_reader(ext: Column, length: Column, content: Column) -> Column:
    """Which reader a file gets: docx, eml, pdf, image or none. An image without bytes has none."""
    return (
        F.when(ext.isin(TEXT_EXTENSIONS), F.substring(ext, 2, 9))
        .when(ext.isin(list(MEDIA_TYPES)) & (length > 0) & content.isNotNull(), "image")
        .otherwise("none")
    )


def extract_contents(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Files -> ``kind, text, image_base64, media_type``, bytes dropped.

    One pass over the files: Word files and emails are decoded by an Arrow function, images are
    encoded by Spark. ``pages`` (``file_id, page_no, text, error``) holds the page texts of PDF
    files, from the decoder of your choice; a PDF without pages has no text.
    """
    keep = [c for c in files.columns if c not in ("content", "error")]
    reader, content = F.col("_reader"), F.col("content")
    typed = files.withColumn("_reader", file_reader(F.col("ext"), F.col("length"), content))
    read = typed.withColumn("_text", document_text(reader, content))
    image = reader == "image"
    out = read.select(
        *keep,
        "_reader",
        F.when(image, "image").when(reader == "none", "unsupported").otherwise("text").alias("kind"),
        F.when(reader == "pdf", "").otherwise(F.col("_text")).alias("text"),
        F.when(image, image_base64(content)).alias("image_base64"),
        F.when(image, media_type(F.col("ext"))).alias("media_type"),
    )
    if pages is not None:
        page_text = assemble_pages(pages).withColumnRenamed("text", "_pages")
        out = out.join(page_text, "file_id", "left").withColumn(
            "text", F.when(reader == "pdf", F.coalesce("_pages", F.lit(""))).otherwise(F.col("text"))
        ).select(*out.columns)
    return out.drop("_reader")
