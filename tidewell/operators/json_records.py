"""JSON objects as text, grouped chunks and enriched headers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: parts of field names that mean text, and that mean metadata (text wins)
TEXT_NAMES = """description content text body message details answer response summary info information question query title name subject rules policy procedure steps
instructions benefits features includes""".split()
METADATA_NAMES = "id type category tag status date created updated author priority version code sku".split()

# fixed values: words that stand beside a category (three are used) or a tag (two are used)
CATEGORY_WORDS = {
    "data": ["internet", "mobile data", "data package"], "social": ["social media", "facebook", "instagram"], "entertainment": ["video", "streaming", "youtube"],
    "gaming": ["games", "esports", "online gaming"], "productivity": ["work", "business", "office"], "combo": ["bundle", "package deal", "combined plan"],
    "roaming": ["international", "global", "travel"],
}
TAG_WORDS = {
    "daily": ["day", "24 hours"], "weekly": ["week", "7 days"], "monthly": ["month", "30 days"], "budget": ["cheap", "affordable"], "light_usage": ["light user", "basic"],
    "heavy_usage": ["heavy user", "unlimited"], "youth": ["student", "young"], "corporate": ["business", "enterprise"], "travel": ["roaming", "international"],
    "social_media": ["facebook", "instagram"], "video_streaming": ["youtube", "netflix"], "low_latency": ["fast", "quick"], "remote_work": ["work from home", "wfh"],
}
# fixed values: header lines
PRICE_TIERS = [(500, "[Budget-friendly] [Affordable] [Economical]"), (1500, "[Mid-range] [Value pack]")]
PRICE_TOP = "[Premium] [High-end] [Professional]"
VALIDITY = {1: "Daily (1 day, 24 hours, short-term)", 7: "Weekly (7 days, one week)", 30: "Monthly (30 days, one month, long-term)"}
RULE = "=" * 60


def field_roles(sample: dict) -> tuple[list[str], list[str]]:
    """Text and metadata fields of a sample object: by name, else a string of over 50 characters is text."""
    text, meta = [], []
    for name, value in sample.items():
        low = name.lower()
        if any(p in low for p in TEXT_NAMES):
            text.append(name)
        elif not any(p in low for p in METADATA_NAMES) and isinstance(value, str) and len(value) > 50:
            text.append(name)
        else:
            meta.append(name)
    return text, meta


def structure(document: str) -> dict:
    """What a JSON text holds: an array, an object around its first non-empty array, or one object; roles come from the first element."""
    data = json.loads(document)
    if isinstance(data, list):
        kind, items, where = "array", data, None
    else:
        where = next((k for k, v in data.items() if isinstance(v, list) and v), None)
        kind, items = ("object_with_array", data[where]) if where is not None else ("single_object", [data])
    first = items[0] if items and isinstance(items[0], dict) else {}
    text, meta = field_roles(first)
    return {"type": kind, "array_field": where, "total_items": len(items), "sample_keys": list(first), "text_fields": text, "metadata_fields": meta}


def title(key: str) -> str:
    return key.replace("_", " ").title()


def format_value(value, depth: int = 0, most: int = 3) -> str:
    """Scalars as they are; lists of scalars by commas, of objects (five) by bars; objects (ten fields) by dots; deeper ones raw."""
    if value is None and depth < most:
        return ""
    if depth >= most or not isinstance(value, (list, dict)):
        return str(value)
    if isinstance(value, list):
        if all(isinstance(v, (str, int, float, bool)) for v in value):
            return ", ".join(map(str, value))
        return " | ".join(format_value(v, depth + 1, most) for v in value[:5])
    shown = ((title(k), format_value(v, depth + 1, most)) for k, v in list(value.items())[:10])
    return " • ".join(f"{k}: {v}" for k, v in shown if v)


def object_text(obj: dict, text_fields: list[str] | None = None, everything: bool = True, most: int = 3) -> str:
    """Text fields first (strings bare), then the others as ``Title: value`` lines."""
    first = [f for f in text_fields or [] if f in obj]
    lines = []
    for name in [*first, *(f for f in obj if everything and f not in first)]:
        value = obj[name]
        if name in first and isinstance(value, str) and value.strip():
            lines.append(value.strip())
        elif shown := format_value(value, 0, most):
            lines.append(f"{title(name)}: {shown}")
    return "\n".join(lines)


def objects_as_text(rows: DataFrame, json_col: str, text_fields: list[str], out: str = "text") -> DataFrame:
    """Open-schema objects in a JSON column as text; what isn't a JSON object gives null."""
    @F.pandas_udf("string")
    def convert(column: pd.Series) -> pd.Series:
        def one(x):
            try:
                found = json.loads(x) if x is not None else None
            except ValueError:
                return None
            return object_text(found, text_fields) if isinstance(found, dict) else None
        return column.map(one)

    return rows.withColumn(out, convert(F.col(json_col)))


def fields_as_text(text_fields: list[Column], others: dict[str, Column]) -> Column:
    """The same for a known schema, on the JVM: text columns bare, the others titled; nulls and blanks are left out."""
    bare = [F.nullif(F.trim(c), F.lit("")) for c in text_fields]
    named = [F.concat(F.lit(f"{title(k)}: "), F.nullif(c.cast("string"), F.lit(""))) for k, c in others.items()]
    return F.concat_ws("\n", *bare, *named)


def grouped(objects: DataFrame, size: int, *, order: str, per: str) -> DataFrame:
    """``objects(per, order, text, ...)`` in groups of ``size`` by order: ``(per, group_no, text, n_objects, first_<order>)``."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(per).orderBy(order)) - 1
    numbered = objects.withColumn("group_no", F.floor(at / size).cast("int"))
    parts = numbered.groupBy(per, "group_no").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("p"))  # size rows at most
    return parts.select(per, "group_no", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"), F.size("p").alias("n_objects"), F.col("p")[0]["o"].alias(f"first_{order}"))


def _lookup(words: dict[str, list[str]], key: Column) -> Column:
    return F.create_map(*(x for k, v in words.items() for x in (F.lit(k), F.lit(f" ({', '.join(v)})"))))[key]


def header(*, name: Column | None = None, category: Column | None = None, price: Column | None = None, days: Column | None = None, tags: Column | None = None,
           policy: Column | None = None, policy_title: Column | None = None) -> Column:
    """Header lines of an object's fields, each only where its value isn't null."""
    lines: list[Column] = []
    if name is not None:
        lines.append(F.concat(F.lit("📦 "), name))
    if category is not None:
        lines.append(F.concat(F.lit("Category: "), category, F.coalesce(_lookup(CATEGORY_WORDS, category), F.lit(""))))
    if price is not None:
        tier = F.lit(PRICE_TOP)
        for bound, label in reversed(PRICE_TIERS):
            tier = F.when(price < bound, F.lit(label)).otherwise(tier)
        lines.append(F.concat(F.lit("💰 Price: LKR "), price.cast("string"), F.lit("\n"), tier))
    if days is not None:
        said = F.concat(days.cast("string"), F.lit(" days"))
        for n, label in VALIDITY.items():
            said = F.when(days == n, F.lit(label)).otherwise(said)
        lines.append(F.concat(F.lit("⏱️ Validity: "), said))
    if tags is not None:
        each = F.transform(tags, lambda t: F.concat(F.initcap(F.replace(t, F.lit("_"), F.lit(" "))), F.coalesce(_lookup(TAG_WORDS, t), F.lit(""))))
        lines.append(F.when(tags.isNotNull(), F.concat(F.lit("🏷️ Features: "), F.array_join(each, " | "))))
    if policy is not None:
        lines.append(F.concat(F.lit("📋 Policy: "), policy))
    if policy_title is not None:
        lines.append(F.concat(F.lit("📄 "), policy_title))
    return F.concat_ws("\n", *lines)


def enriched(text: Column, head: Column) -> Column:
    """The header above a rule above the text; the bare text under an empty header."""
    return F.when(head == "", text).otherwise(F.concat(head, F.lit(f"\n\n{RULE}\n\n"), text))


def matches(metadata: Column, wanted: dict[str, object]) -> Column:
    """All dotted paths of a JSON column equal their wanted values, types included: the text "7" isn't the number 7, and 7 is 7.0.

    A missing path never matches, but that a plain name wanted as None may be missing; lists and objects match whole.  Broken JSON matches nothing.
    """
    whole = F.try_parse_json(metadata)
    out = whole.isNotNull()
    for path, value in wanted.items():
        found = F.try_variant_get(whole, "$" + "".join(f"[{json.dumps(p)}]" for p in path.split(".")), "variant")
        kind = F.schema_of_variant(found)
        if value is None:
            same = F.is_variant_null(found) | (found.isNull() if "." not in path else F.lit(False))
        elif isinstance(value, bool):
            same = (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == F.lit(value))
        elif isinstance(value, (int, float)):
            same = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(found, "$", "double") == F.lit(float(value)))
        elif isinstance(value, str):
            same = (kind == "STRING") & (F.try_variant_get(found, "$", "string") == F.lit(value))
        else:
            same = F.to_json(found) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
        out = out & F.coalesce(same, F.lit(False))
    return out


def mood_reply(reply: Column) -> Column:
    """The first ``{...}`` of a model's reply as ``struct<emotion, intensity, wants_human>``; intensity is kept within 1 to 5, unknown moods are neutral."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    emotion = F.get_json_object(body, "$.emotion")
    return F.struct(F.when(emotion.isin("neutral", "happy", "confused", "frustrated", "angry"), emotion).otherwise("neutral").alias("emotion"),
                    F.least(F.greatest(F.coalesce(F.try_to_number(F.get_json_object(body, "$.intensity"), F.lit("9")).cast("int"), F.lit(1)), F.lit(1)), F.lit(5)).alias("intensity"),
                    F.coalesce(F.get_json_object(body, "$.wants_human") == "true", F.lit(False)).alias("wants_human"))
