"""Parsers of generated responses and builders of prompts, as column expressions.

A parser gives null for a response that breaks its format, so that a whole batch can be asked for again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTES = "'\"“”‘’"


def exactly(items: Column, n: Column | int) -> Column:
    """The items if there are just n of them, else null."""
    return F.when(F.size(items) == n, items)


def line_list(text: Column) -> Column:
    """The lines that aren't blank, without a leading '- '."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.startswith(x, F.lit("- ")), F.substr(x, F.lit(3))).otherwise(x))
    return F.filter(lines, lambda x: x.rlike(r"\S"))


def between_marks(text: Column) -> Column:
    """The sample of '... >>sample<<'; null unless there is one opening and one closing mark and no other '<' after the first."""
    parts = F.split(text, ">>")
    last = parts[F.size(parts) - 1]
    ok = (F.size(parts) == 2) & ~F.contains(text, F.lit(">><<")) & (F.regexp_count(last, F.lit("<")) == 2) & F.contains(last, F.lit("<<"))
    return F.when(ok, F.split(last, "<<")[0])


def unwrapped(text: Column) -> Column:
    """A response of one line without white space around it and without a pair of straight quotation marks around it; null
    if more than one line isn't blank."""
    bare = F.regexp_replace(text, r"^\s+|\s+\z", "")
    pair = (F.length(bare) > 1) & ((F.startswith(bare, F.lit('"')) & F.endswith(bare, F.lit('"'))) | (F.startswith(bare, F.lit("'")) & F.endswith(bare, F.lit("'"))))
    inner = F.when(pair, F.regexp_replace(F.substr(bare, F.lit(2), F.length(bare) - 2), r"^\s+|\s+\z", "")).otherwise(bare)
    return F.when(F.size(F.filter(F.split(inner, "\n"), lambda x: x.rlike(r"\S"))) <= 1, inner)


def json_items(text: Column) -> Column:
    """The list of a JSON response: the response itself, its field 'sentences', or else its first field that is a list."""
    fields = F.from_json(text, "map<string,string>")
    first = F.try_element_at(F.filter(F.map_values(fields), lambda v: v.rlike(r"^\s*\[")), F.lit(1))
    kind = "array<struct<text:string,label:string>>"
    own = F.when(text.rlike(r"^\s*\["), text)
    return F.from_json(F.coalesce(own, F.when(F.try_element_at(fields, F.lit("sentences")).rlike(r"^\s*\["), F.try_element_at(fields, F.lit("sentences"))), first), kind)


def valid_batch(items: Column, size: int, label: str, least: int = 8) -> Column:
    """The texts of items(text, label) if there are just size of them, all of the label, of ``least`` characters or more and
    without line breaks; else null."""
    good = F.forall(items, lambda x: F.coalesce((x["label"] == label) & (F.length(x["text"]) >= least) & ~F.contains(x["text"], F.lit("\n")), F.lit(False)))
    return F.when((F.size(items) == size) & good, F.transform(items, lambda x: x["text"]))


def filled(template: str, **parts: Column) -> Column:
    """A template with each {name} replaced by its column; a null column leaves nothing in its place."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def bullet_list(items: Column) -> Column:
    """'- a', '- b', ... one a line."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def record_fields(text: Column) -> Column:
    """The named fields of a record as a map with names in lower case: a JSON object, 'name: value' joined by ' | ' or
    'name=value' joined by '; ', white space and a byte order mark around it ignored. Null for any other text; of a name
    that comes twice the last value counts."""
    bare = F.regexp_replace(text, r"^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+\z", "")

    def pairs(sep: str, mark: str) -> Column:
        name = r"[\p{L}_][\p{L}\p{N}_ ]*?"
        parts = F.split(bare, rf"\s*{sep}\s*(?={name}\s*{mark})")
        whole = (F.size(parts) > 1) & F.forall(parts, lambda x: x.rlike(rf"(?s)^{name}\s*{mark}.*$"))
        at = F.transform(parts, lambda x: F.struct(F.lower(F.regexp_extract(x, rf"(?s)^({name})\s*{mark}\s*(.*?)\s*$", 1)).alias("key"), F.regexp_extract(x, rf"(?s)^({name})\s*{mark}\s*(.*?)\s*$", 2).alias("value")))
        return F.when(whole, at)

    json = F.when(F.startswith(bare, F.lit("{")), F.transform(F.map_entries(F.from_json(bare, "map<string,string>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    found = F.coalesce(json, pairs(r"\|", ":"), pairs(";", "="))
    last = F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)
