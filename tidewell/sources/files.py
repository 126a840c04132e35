"""Readers of JSON and PDF files and webhook payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.json_records import structure
from tidewell.sources.collections import Collections  # noqa: F401

WEBHOOK = ("entry array<struct<changes: array<struct<value: struct<metadata: struct<phone_number_id: string>, "
           "messages: array<struct<type: string, `from`: string, id: string, text: struct<body: string>>>>>>>>")


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kind, item_no, object)`` of JSON files: arrays, objects around an array, or single objects; broken files give an error."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                text = bytes(content).decode("utf-8")
                try:
                    found, data = structure(text), json.loads(text)
                except ValueError as e:
                    raise ValueError(f"{file}: invalid JSON: {e}") from e
                items = data if found["type"] == "array" else data[found["array_field"]] if found["array_field"] is not None else [data]
                rows += [(file, found["type"], i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(items)]
            yield pd.DataFrame(rows, columns=["file", "kind", "item_no", "object"])

    if not path.split("?")[0].lower().endswith((".json", "*", "/")):
        raise ValueError(f"not a JSON file: {path}")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, kind string, item_no int, object string")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(file, page, text)``, blank pages left out, read by pypdf, which the workers need."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF needs the pypdf package on the workers") from e
        for pdf in batches:
            rows = [(file, n, text) for file, content in zip(pdf["path"], pdf["content"], strict=True)
                    for n, page in enumerate(PdfReader(io.BytesIO(bytes(content))).pages, 1) if (text := page.extract_text() or "").strip()]
            yield pd.DataFrame(rows, columns=["file", "page", "text"])

    if not path.lower().endswith((".pdf", "*", "/")):
        raise ValueError(f"not a PDF file: {path}")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, page int, text string")


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix."""
    low = path.lower()
    if low.endswith(".json"):
        return read_json_objects(spark, path)
    if low.endswith(".pdf"):
        return read_pdf_pages(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def webhook_messages(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Text messages of webhook envelopes: ``(phone_number_id, sender, message_id, body)``."""
    parsed = payloads.select(F.from_json(F.col(column), WEBHOOK).alias("p"))
    changes = parsed.select(F.explode("p.entry").alias("e")).select(F.explode("e.changes").alias("c"))
    messages = changes.select(F.col("c.value.metadata.phone_number_id").alias("phone_number_id"), F.explode("c.value.messages").alias("m"))
    return messages.where("m.type = 'text' AND m.`from` IS NOT NULL AND coalesce(m.text.body, '') <> '' AND phone_number_id IS NOT NULL") \
        .select("phone_number_id", F.col("m.from").alias("sender"), F.col("m.id").alias("message_id"), F.col("m.text.body").alias("body"))
