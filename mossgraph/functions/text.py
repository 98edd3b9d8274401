"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and media types by file extension.
MEDIA = {
    "md": ("markdown", "text/markdown"), "canvas": ("canvas", "application/json"), "txt": ("text", "text/plain"), "csv": ("text", "text/csv"), "json": ("text", "application/json"),
    "svg": ("image", "image/svg+xml"), "png": ("image", "image/png"), "jpg": ("image", "image/jpeg"), "jpeg": ("image", "image/jpeg"), "gif": ("image", "image/gif"), "webp": ("image", "image/webp"),
    "pdf": ("document", "application/pdf"), "mp3": ("audio", "audio/mpeg"), "wav": ("audio", "audio/wav"), "mp4": ("video", "video/mp4"), "webm": ("video", "video/webm"),
}


_TERM = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; each ideograph is a term of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def term_count(text: Column) -> Column:
    """How many ``terms`` a text has, without listing them."""
    return F.regexp_count(F.lower(text), F.lit(_TERM))


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def utf16_length(text: Column) -> Column:
    """Characters as the JVM counts them: two for each beyond U+FFFF."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def link_form(target: Column) -> Column:
    """A link target trimmed, without leading ./ or one /, and without one .md."""
    trimmed = F.trim(target)
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"^(\./)+", ""), "^/", "")
    return F.when(F.contains(trimmed, F.lit(".")) | F.startswith(trimmed, F.lit("/")), F.regexp_replace(bare, r"(?i)\.md$", "")).otherwise(trimmed)


def suffixes(document_id: Column) -> Column:
    """a/b/c: a/b/c, b/c, c."""
    parts = F.split(document_id, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _media(path: Column, which: int, other: str) -> Column:
    known = F.create_map(*(F.lit(x) for k, v in MEDIA.items() for x in (k, v[which])))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(other))


def file_kind(path: Column) -> Column:
    return _media(path, 0, "other")


def media_type(path: Column) -> Column:
    return _media(path, 1, "application/octet-stream")


def is_attachment(path: Column) -> Column:
    return ~extension(path).isin("md", "canvas")


def daily_note(path: Column) -> Column:
    """The date that a file name states, if there is such a day."""
    name = F.regexp_extract(path, r"(?:^|/)(\d{4}-\d{2}-\d{2})(?:\.md)?$", 1)
    return F.try_to_date(F.nullif(name, F.lit("")), "yyyy-MM-dd")


def daily_note_path(day: Column, folder: str = "notes/daily") -> Column:
    return F.concat(F.lit(folder + "/"), F.date_format(day, "yyyy-MM-dd"), F.lit(".md"))


def expand(template: Column, values: dict[str, Column]) -> Column:
    """``{{key}}`` becomes its value; unknown keys stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{{" + kv[0] + "}}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def cursor(document_id: Column) -> Column:
    """An opaque cursor: base64url without padding."""
    return F.rtrim(F.translate(F.base64(document_id.cast("binary")), "+/", "-_"), F.lit("="))


def from_cursor(value: Column) -> Column:
    padded = F.concat(F.translate(value, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(value), F.lit(4))))
    return F.unbase64(padded).cast("string")


def encode_props(props: Column) -> Column:
    """key=value&..., keys in order, with \\, & and = escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("&"), F.lit("\\&")), F.lit("="), F.lit("\\="))
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]))), "&")


def decode_props(text: Column) -> Column:
    """The map that ``encode_props`` has written."""
    bare = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    pairs = F.filter(F.regexp_extract_all(text, F.lit(r"((?:[^\\&]|\\.)+)(?:&|$)"), F.lit(1)), lambda p: p != "")
    sides = F.transform(pairs, lambda p: F.struct(bare(F.regexp_extract(p, r"^((?:[^\\=]|\\.)*)=", 1)).alias("key"), bare(F.regexp_extract(p, r"^(?:[^\\=]|\\.)*=(.*)$", 1)).alias("value")))
    return F.map_from_entries(sides)


def has_control(text: Column) -> Column:
    """Whether a front-matter scalar has a control character besides \\n, \\r and \\t."""
    return F.rlike(text, F.lit(r"[\p{Cntrl}&&[^\n\r\t]]"))


def canvas_text(content: Column) -> Column:
    """The text nodes of a canvas, by blank lines; what cannot be read as one stays as it is."""
    parsed = F.from_json(content, "struct<nodes:array<struct<type:string,text:string>>>")
    nodes = F.filter(parsed["nodes"], lambda n: (n["type"] == "text") & n["text"].isNotNull())
    return F.coalesce(F.array_join(F.transform(nodes, lambda n: n["text"]), "\n\n"), content)


def indexable(path: Column, content: Column) -> Column:
    """What of a file is searched: null for kinds without text."""
    kind = extension(path)
    return F.when(kind == "canvas", canvas_text(content)).when(kind.isin("md", "txt", "csv", "json", "svg"), content)


def snippet(content: Column, position: Column, before: int = 40, size: int = 200) -> Column:
    """``size`` characters from ``before`` ahead of a match (1-based; 0 or null: the head)."""
    return F.substring(content, F.greatest(F.coalesce(position, F.lit(0)) - before, F.lit(1)), F.lit(size))


def is_han(word: str) -> bool:
    """Whether a term is an ideograph, which is a term of its own."""
    return bool(regex.fullmatch(r"\p{Han}", word))


def highlights(piece: Column, content: Column, words: list[str], size: int = 200) -> Column:
    """Half-open ranges of the query's terms within a snippet; none where the content is no longer than one. An ideograph may stand between other letters."""
    low, letter = F.lower(piece), F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]")

    def ranges(word: str) -> Column:
        before = lambda i: F.when(i > 1, F.substring(low, i - 1, F.lit(1))).otherwise("")
        alone = lambda i: F.lit(True) if is_han(word) else ~F.rlike(before(i), letter) & ~F.rlike(F.substring(low, i + len(word), F.lit(1)), letter)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: (F.substring(low, i, F.lit(len(word))) == word) & alone(i))
        return F.transform(starts, lambda i: F.struct((i - 1).alias("start"), (i - 1 + len(word)).alias("end")))

    found = F.concat(*map(ranges, words))
    return F.when(F.length(content) <= size, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.array_sort(found))


def sanitized(name: Column) -> Column:
    """A file name as a document id: white space collapsed and trimmed, control characters out, .md off."""
    clean = F.regexp_replace(name, r"[\p{Cntrl}]", "")
    parts = F.transform(F.split(F.regexp_replace(clean, r"(?i)\.md$", ""), "/"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")
