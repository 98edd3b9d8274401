"""Writes as their authors send them: checked, parsed, rendered and hashed, then applied.

A command has id and content, and may have collection, path, frontmatter (JSON), tags, author, message, expected_revision and
expected_hash; columns that are absent count as null. What breaks a rule is a row with its reason, beside those that a store refuses.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frontmatter import from_json, parse_yaml, render_document
from ..functions.markdown import in_chunks, split_front
from ..model import (
    DEFAULT_COLLECTION,
    MAX_AUTHOR_BYTES,
    MAX_COLLECTION_BYTES,
    MAX_CONTENT_BYTES,
    MAX_FM_DEPTH,
    MAX_FM_ENTRIES,
    MAX_FM_ITEMS,
    MAX_FM_VALUE_BYTES,
    MAX_ID_BYTES,
    MAX_MESSAGE_BYTES,
    MAX_PATH_BYTES,
    MAX_TAGS,
    InvalidRequest,
)
from . import store

FIELDS = ("id", "content", "collection", "path", "frontmatter", "author", "message", "expected_revision", "expected_hash")
_CONTROL = r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"


def _bad(value: Column, most: int, controls: bool = True) -> Column:
    """Whether a text that is there is blank, longer than so many bytes, or has control characters."""
    out = (F.trim(F.regexp_replace(value, r"\s", " ")) == "") | (F.octet_length(value) > most)
    return F.coalesce(out | F.regexp_like(value, F.lit(_CONTROL)) if controls else out, F.lit(False))


def _not_relative(value: Column) -> Column:
    """Whether a path leaves its root or has empty parts; a drive or scheme is not relative either."""
    parts = F.split(value, "/", -1)
    return F.coalesce((value != F.trim(value)) | F.contains(value, F.lit("\\")) | F.contains(parts[0], F.lit(":")) | F.exists(parts, lambda p: F.trim(p).isin("", ".", "..")), F.lit(False))


def problem(commands: DataFrame) -> Column:
    """The first rule that a command breaks, null if none."""
    at = lambda c, kind="string": F.col(c) if c in commands.columns else F.lit(None).cast(kind)
    tags = at("tags", "array<string>")
    return (
        F.when(F.col("id").isNull() | _bad(F.col("id"), MAX_ID_BYTES) | _not_relative(F.col("id")) | F.endswith(F.lower("id"), F.lit(".md")), "id")
        .when(_bad(at("collection"), MAX_COLLECTION_BYTES), "collection")
        .when(_bad(at("path"), MAX_PATH_BYTES) | F.coalesce(at("path") != F.concat("id", F.lit(".md")), F.lit(False)), "path")
        .when(F.coalesce((F.size(tags) > MAX_TAGS) | F.exists(tags, lambda t: t.isNull() | _bad(t, MAX_COLLECTION_BYTES, False)), F.lit(False)), "tags")
        .when(_bad(at("author"), MAX_AUTHOR_BYTES), "author")
        .when(_bad(at("message"), MAX_MESSAGE_BYTES), "message")
        .when(_bad(at("expected_revision"), MAX_ID_BYTES), "revision")
        .when(F.col("content").isNull() | (F.octet_length("content") > MAX_CONTENT_BYTES), "content")
    )


def _limited(value: object, depth: int = 1) -> None:
    if depth > MAX_FM_DEPTH:
        raise InvalidRequest("front matter is nested too deep")
    if isinstance(value, list | dict):
        if len(value) > (MAX_FM_ITEMS if isinstance(value, list) else MAX_FM_ENTRIES):
            raise InvalidRequest("front matter has too many values")
        for v in value.values() if isinstance(value, dict) else value:
            _limited(v, depth + 1)
    elif len(str(value).encode()) > MAX_FM_VALUE_BYTES:
        raise InvalidRequest("a value of the front matter is too long")


def rendered_one(content: str, frontmatter: str | None) -> tuple[str | None, str | None, str | None]:
    """The document as it is stored, why its own front matter could not be read, and why a given one is refused.

    A block of the content stays as it was written; given front matter takes its place. Line ends are \\n."""
    block, body = split_front(content)
    degraded = parse_yaml(block)[1] if block is not None else None
    if frontmatter is None:
        return (body if block is None or not block.strip() else f"---\n{block.rstrip(chr(10))}\n---\n{body}"), degraded, None
    try:
        values = from_json(frontmatter)
        if not isinstance(values, dict):
            raise InvalidRequest("front matter must be an object")
        _limited(values)
        return render_document(values, body), degraded, None
    except (ValueError, TypeError, RecursionError) as e:
        return None, degraded, f"frontmatter: {e}"


def rendered(content: Column, frontmatter: Column) -> Column:
    """content, degraded and refused, as by ``rendered_one``; of a batch, few are Python objects at once."""
    names = ["content", "degraded", "refused"]

    def made(contents: list[str | None], given: list[str | None]) -> pa.Array:
        columns = zip(*(rendered_one(c or "", f) for c, f in zip(contents, given, strict=True)), strict=True) if contents else [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names)

    @F.arrow_udf(", ".join(f"{n} string" for n in names))
    def run(contents: pa.Array, given: pa.Array) -> pa.Array:
        return in_chunks(made, contents, given)

    return run(content, frontmatter)


def prepared(commands: DataFrame, documents: DataFrame) -> DataFrame:
    """Commands with content as it is stored, the collection (the given one, the document's, the default one), created, degraded and reason.

    ``commands`` have an id once each; of several, all are refused, as their order is not known."""
    held = documents.select("id", F.col("collection").alias("_held"), F.lit(True).alias("_there"))
    given = commands.select(*(F.col(c) if c in commands.columns else F.lit(None).cast("string").alias(c) for c in FIELDS), problem(commands).alias("_problem"))
    repeated = given.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("repeated").alias("_repeated"))
    made = given.join(repeated, "id", "left").join(held, "id", "left")
    ok = F.col("_problem").isNull()
    made = made.withColumn("_r", rendered(F.when(ok, F.col("content")), F.when(ok, F.col("frontmatter"))))
    reason = F.coalesce("_problem", "_repeated", "_r.refused", F.when(F.octet_length("_r.content") > MAX_CONTENT_BYTES, "content"))
    return made.select("id", F.coalesce("collection", "_held", F.lit(DEFAULT_COLLECTION)).alias("collection"), F.col("_r.content").alias("content"), "author", "message", "expected_revision", "expected_hash", F.col("_there").isNull().alias("created"), F.col("_r.degraded").alias("degraded"), reason.alias("reason"))


def upsert(state: store.State, ready: DataFrame, now: Column) -> store.State:
    """The state after ``prepared`` commands; the hash of the content as it is stored is its revision too. Refused ones are conflicts with their reason."""
    made = store.upsert(state, ready.where("reason IS NULL"), now)
    refused = ready.where("reason IS NOT NULL").select("id", "reason")
    return store.State(made.documents, made.revisions, made.edges, made.outbox, made.conflicts.unionByName(refused), made.delta)
