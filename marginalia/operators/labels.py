"""Labels ``namespace:value``: validation, containment, inference, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NAMESPACE = "^[a-z][a-z0-9_-]*$"


def normal_label(label: Column) -> Column:
    """(namespace, value) or null: namespace lower-cased, the value's case kept."""
    at = F.instr(label, F.lit(":"))
    namespace = F.lower(F.btrim(F.substring(label, F.lit(1), at - 1)))
    value = F.btrim(F.substring(label, at + 1, F.length(label)))
    good = (at > 0) & namespace.rlike(NAMESPACE) & (value != "") & ~label.rlike(r"[\x00-\x1f\x7f-\x9f\x{2028}\x{2029}]")
    return F.when(good, F.struct(namespace.alias("namespace"), value.alias("value")))


def normalize(labels: Column) -> Column:
    """Sorted distinct labels, composed; null if any of them is malformed."""
    labels = T.nfc_all(labels)
    parts = F.transform(labels, normal_label)
    whole = F.array_sort(F.array_distinct(parts))
    joined = F.transform(whole, lambda p: F.concat(p["namespace"], F.lit(":"), p["value"]))
    return F.when(F.exists(labels, lambda x: normal_label(x).isNull()), None).otherwise(joined)


def has_all(labels: Column, wanted: Column) -> Column:
    """Whether the labels hold every wanted one; malformed labels never match, no wish always does."""
    have = normalize(F.coalesce(labels, F.array().cast("array<string>")))
    return (F.size(wanted) == 0) | F.coalesce(F.size(F.array_except(wanted, have)) == 0, F.lit(False))


def histogram(notes: DataFrame, column: str = "labels") -> DataFrame:
    """(label, notes): each label once a note."""
    return notes.select(F.explode(F.array_distinct(column)).alias("label")).groupBy("label").agg(F.count("*").alias("notes"))


def suggest(notes: DataFrame) -> DataFrame:
    """(key, labels) from header fields, typed links, dates, script and zone.

    ``notes``: (key, text, type, zone, created, language), any of them null.
    """
    tag = lambda ns, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(ns + ":"), v))
    text = F.coalesce(F.col("text"), F.lit(""))
    typed = F.transform(T.typed_wikilinks(text), lambda x: F.concat(x["namespace"], F.lit(":"), x["target"]))
    dates = F.transform(T.iso_dates(text), lambda d: F.concat(F.lit("date:"), d))
    fixed = F.array(tag("type", F.col("type")), tag("zone", F.col("zone")), tag("created", T.iso_date(F.col("created"))), tag("language", F.coalesce("language", T.script_language(text))))
    found = F.filter(F.concat(fixed, typed, dates), lambda x: x.isNotNull())
    return notes.select("key", normalize(found).alias("labels"))


#: Stand-ins for an escaped backslash and an escaped quote while items are parted; no character has these codes.
_BACKSLASH, _QUOTE = "\ufffe", "\uffff"


def read_inline(header: Column) -> Column:
    """Labels of a one-line ``labels: [..]`` header field, or null without one.

    Escapes are replaced first, so a quoted item is a run of one class of characters:
    Java's matcher recurses a level for each turn of a repeated group, and a long
    label would end the executor.
    """
    raw = F.regexp_extract(header, r"(?m)^labels:[ \t]*\[(.*)\][ \t]*$", 1)
    raw = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    found = F.regexp_extract_all(raw, F.lit(r"\"[^\"]*+\"|'[^']*+'|[^,\s\"'][^,]*+"), F.lit(0))

    def item(x: Column) -> Column:
        inner = F.substr(x, F.lit(2), F.char_length(x) - 2)
        back = lambda t, slash, quote: F.replace(F.replace(t, F.lit(_BACKSLASH), F.lit(slash)), F.lit(_QUOTE), F.lit(quote))
        return F.btrim(F.when(x.startswith('"'), back(inner, "\\", '"')).when(x.startswith("'"), back(inner, "\\\\", '\\"')).otherwise(back(x, "\\\\", '\\"')))

    return F.when(header.rlike(r"(?m)^labels:[ \t]*\["), normalize(F.transform(found, item)))
