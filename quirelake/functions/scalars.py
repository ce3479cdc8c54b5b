"""Scalar expressions: numbers, dates, formats, labels. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_percent(part: Column, total: Column) -> Column:
    """part of total in whole percent, cut off; 0 where total is 0."""
    p, t = part.cast("long"), total.cast("long")
    return F.when(t > 0, F.call_function("div", p * 100, t)).otherwise(F.lit(0).cast("long"))


def div(a: Column, b) -> Column:
    return F.call_function("div", a.cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def large_number(n: Column) -> Column:
    """12345 -> 1.2万, 80000000 -> 0.800亿 (from 10 million on), small numbers as they are."""
    return (
        F.when(n >= 10_000_000, F.concat(F.format_string("%.3f", n / 1e8), F.lit("亿")))
        .when(n >= 10_000, F.concat(F.format_string("%.1f", n / 1e4), F.lit("万")))
        .otherwise(n.cast("string"))
    )


def duration(seconds: Column) -> Column:
    """3661 -> 1小时1分钟, 120 -> 2分钟, 59 -> 59秒."""
    h, m = div(seconds, 3600), div(seconds % 3600, 60)
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("小时"), m.cast("string"), F.lit("分钟")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("分钟")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("秒")))
    )


def byte_size(n: Column) -> Column:
    k = 1024
    return (
        F.when(n >= k**3, F.format_string("%.2f GB", n / float(k**3)))
        .when(n >= k**2, F.format_string("%.1f MB", n / float(k**2)))
        .when(n >= k, F.format_string("%.1f KB", n / float(k)))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def page_label_percent(label: Column) -> Column:
    """"189 / 1987" -> "9%"; other labels as they are."""
    page, total = (F.regexp_extract(label, r"^(\d+)\s*/\s*(\d+)$", i).try_cast("long") for i in (1, 2))
    return F.when(total > 0, F.concat(div(F.least(page, total) * 100, total).cast("string"), F.lit("%"))).otherwise(label)


def elapsed_seconds(start_ms: Column, end_ms: Column) -> Column:
    return div(end_ms - start_ms, 1000)


def clock_seconds(value: Column) -> Column:
    """SMIL clock values: h:m:s, m:s, or a number with h, min, s, ms or nothing; else null."""
    v = F.trim(value)
    part = lambda i: F.regexp_extract(v, r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$", i)
    number, unit = (F.regexp_extract(v, r"^(\d+(?:\.\d+)?)(h|min|s|ms)?$", i) for i in (1, 2))
    clock = F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double")
    scale = F.when(unit == "h", 3600.0).when(unit == "min", 60.0).when(unit == "ms", 0.001).otherwise(1.0)
    return F.when(v.contains(":"), clock).otherwise(number.try_cast("double") * scale)


def iso_instant(value: Column) -> Column:
    """An instant in ISO-8601; null for anything else."""
    return F.when(value.rlike(r"^\s*\d{4}-\d{2}"), F.try_to_timestamp(value))


def within_days(ts: Column, now: Column, days: int) -> Column:
    """Whether ts is not older than so many days at now."""
    return ts >= now - F.expr(f"INTERVAL {days} DAYS")


def pmi(f: Column, n: Column, a: Column, b: Column) -> Column:
    return F.log(f * n / (a * b))


def idf(listed: Column, df: Column, median: Column) -> Column:
    """The listed value, else one from the document frequency, else the median."""
    return F.coalesce(listed, F.lit(1.0) + F.log1p(F.lit(1e6) / df), median)


def pos_weight(tag: Column) -> Column:
    """Verbs .2, verbal nouns .85, adjectives .6, others 1."""
    return F.when(tag == "v", 0.2).when(tag == "vn", 0.85).when(tag.isin("a", "an"), 0.6).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm < 1e-9, v).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def popularity(count: Column) -> Column:
    return F.log10(count + 1)


def count_of(popularity_: Column) -> Column:
    return F.pow(F.lit(10.0), popularity_) - 1


def collection_weight(df: Column) -> Column:
    return F.log1p(df)


def cloud_size(weight: Column, least: float = 12.0, most: float = 36.0) -> Column:
    """A word's size in a cloud, linear in its weight."""
    return F.lit(least) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)) * (most - least)


def type_of_label(label: Column) -> Column:
    """A book's type from a free label: the first that occurs in it. Fixed values."""
    ladder = [
        ("短篇同人", "collection_fanfic"),
        ("长篇同人", "fanfic"),
        ("同人", "fanfic"),
        ("历史题材", "history_novel"),
        ("历史学术", "history_academic"),
        ("史书", "history"),
        ("历史", "history"),
        ("长篇网文", "webnovel"),
        ("网文", "webnovel"),
        ("经典名著", "classic"),
        ("名著", "classic"),
        ("短篇小说集", "collection"),
        ("小说集", "collection"),
        ("短篇", "shortstory"),
        ("理工", "stem"),
        ("人文社科", "humanities"),
        ("人文", "humanities"),
    ]
    out = F.when(F.lit(False), "")
    for part, kind in ladder:
        out = out.when(label.contains(part), kind)
    return out.otherwise("general")


def _folded(codes: Column, start: int, step) -> Column:
    return F.aggregate(codes, F.lit(start).cast("long"), step)


def _units(hexadecimal: Column, digits: int) -> Column:
    """Numbers of so many hexadecimal digits each; none of an empty text, null of null."""
    n = F.length(hexadecimal) / digits
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))
    units = F.transform(at, lambda i: F.conv(F.substring(hexadecimal, i * digits + 1, F.lit(digits)), 16, 10).cast("long"))
    return F.when(n > 0, units).when(n == 0, F.array().cast("array<bigint>"))


def fnv1a_32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned 32-bit number."""
    return _folded(_units(F.hex(F.encode(text, "UTF-8")), 2), 2166136261, lambda h, b: F.pmod(h.bitwiseXOR(b) * 16777619, F.lit(1 << 32)))


def string_hash(text: Column) -> Column:
    """The 31-polynomial over UTF-16 units, as a signed 32-bit number."""
    h = _folded(_units(F.hex(F.encode(text, "UTF-16BE")), 4), 0, lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")
