"""Emails: body parts and attachments. Small per-message helpers; Spark moves the rows."""

from __future__ import annotations

import email
import re
from collections.abc import Iterator
from email.headerregistry import BaseHeader
from email.message import EmailMessage
from email.policy import EmailPolicy
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from caseloom.functions.text import extension

_UNSAFE = re.compile(r"[^\w.\-]")
# Longest header that is remembered, and how many are.
HEADER_CHARS, HEADERS = 500, 256


class _Policy(EmailPolicy):
    """The default policy. A message asks for its few headers again and again, and parsing one is most of the time that an
    email takes: the last ones are remembered."""

    def header_fetch_parse(self, name: str, value: str) -> BaseHeader:
        if type(value) is not str or len(value) > HEADER_CHARS:
            return super().header_fetch_parse(name, value)
        found = _seen.get((name, value))
        if found is None:
            if len(_seen) >= HEADERS:
                _seen.clear()
            found = _seen[name, value] = super().header_fetch_parse(name, value)
        return found


_seen: dict[tuple[str, str], BaseHeader] = {}
_policy = _Policy()


class Attachment(NamedTuple):
    ordinal: int
    name: str
    via: str
    content: bytes


def file_name(raw: str | None, ordinal: int) -> str:
    """Python form of `functions.text.safe_name`, for names that leave a worker."""
    fallback = f"attachment_{ordinal}"
    last = (raw or fallback).rsplit("/", 1)[-1]
    return _UNSAFE.sub("_", last).strip("_") or fallback


def attachments(content: bytes) -> Iterator[Attachment]:
    """Attachments of one email; a part that cannot be decoded is left out."""
    try:
        parts = list(email.message_from_bytes(content, policy=_policy).iter_attachments())
    except Exception:
        return
    for ordinal, part in enumerate(parts):
        try:
            payload = part.get_content()
            name, via = file_name(part.get_filename(), ordinal), "attachment"
            if isinstance(payload, EmailMessage):
                payload, via = payload.as_bytes(), "rfc822"
            elif isinstance(payload, str):
                payload = payload.encode("utf-8")
            yield Attachment(ordinal, name, via, bytes(payload))
        except Exception:
            continue


def _body(content: bytes) -> tuple[str, str]:
    """Content type and raw text of the preferred body part."""
    part = email.message_from_bytes(content, policy=_policy).get_body(preferencelist=("plain", "html"))
    if part is None:
        return "none", ""
    text = part.get_content()
    return part.get_content_type(), text.encode("utf-8", "replace").decode("utf-8")


def decode_email(content: bytes) -> tuple[str, str]:
    try:
        return _body(content)
    except Exception:
        return "none", ""


# Bytes of attachments that leave a task in one frame.
FRAME_BYTES = 32 << 20


def explode_attachments(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per attachment of each email, attached emails opened in turn, however deep.

    ``trail`` is the way through nested emails (positions joined by dots) and ``depth`` its length.
    """

    def below(data: bytes) -> Iterator[tuple]:
        waiting = [iter([(item, "", 1) for item in attachments(data)])]
        while waiting:
            item, trail, depth = next(waiting[-1], (None, "", 0))
            if item is None:
                waiting.pop()
                continue
            way = f"{trail}.{item.ordinal}" if trail else str(item.ordinal)
            yield (way, depth, item.ordinal, item.via, item.name, len(item.content), item.content)
            if item.via == "rfc822" or item.name.lower().endswith(".eml"):
                waiting.append(iter([(inner, way, depth + 1) for inner in attachments(item.content)]))

    added = ["trail", "depth", "ordinal", "via", "file_name", "length", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                for found in below(bytes(row[-1])):
                    rows.append((*row[:-1], *found))
                    size += len(found[-1]) + 256
                    if size >= FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=[*keys, *added])
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=[*keys, *added])

    slim = df.select(*keys, content)
    schema = T.StructType([
        *slim.select(*keys).schema.fields,
        T.StructField("trail", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("via", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ])
    return slim.mapInPandas(run, schema).withColumn("ext", extension(F.col("file_name")))
