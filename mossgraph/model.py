"""Tables, limits and vocabularies of a knowledge corpus."""

from __future__ import annotations


class InvalidRequest(ValueError):
    """A request that no plan is made for."""


class Unsupported(RuntimeError):
    """A write on a read-only source."""


#: Schemas, as Spark's DDL.
DOCUMENTS = (
    "id string, collection string, path string, content string, content_hash string, revision string, updated_at timestamp, deleted boolean, title string, author string, "
    "tags array<string>, aliases array<string>, raw_frontmatter string, fm array<struct<key:string,kind:string,text:string,term:string>>"
)
REVISIONS = ("doc_id string, revision string, author string, message string, content_hash string, content string, created_at timestamp, deps array<string>")
EDGES = ("src string, dst string, rel string, props map<string,string>")
VECTORS = ("id string, chunk int, model string, dim int, vector array<float>")
BLOBS = ("hash string, algorithm string, size long, bytes binary")
OUTBOX = (
    "id string, document_id string, revision string, content_hash string, kind string, edge_version string, projection_version string, created_at timestamp, attempts int, dead_lettered boolean, "
    "lease_owner string, lease_token string, lease_expires_at timestamp"
)
CHANGES = ("sequence long, document_id string, collection string, kind string, revision string, content_hash string")

#: Limits of requests.
MAX_PAGE, MAX_OFFSET, MAX_DEPTH, MAX_BATCH, MAX_TAGS, MAX_QUERY_BYTES, MAX_CONTENT_BYTES, MAX_DELETED_PAGE, MAX_FANOUT = 500, 10_000, 10, 100, 64, 4096, 1 << 20, 200, 1000
MAX_ID_BYTES, MAX_COLLECTION_BYTES, MAX_PATH_BYTES, MAX_AUTHOR_BYTES, MAX_MESSAGE_BYTES = 512, 128, 1024, 128, 512
MAX_FM_ENTRIES, MAX_FM_ITEMS, MAX_FM_DEPTH, MAX_FM_VALUE_BYTES = 64, 64, 8, 4096
#: Relations that edges may have, and other spellings of them.
RELATIONS = ("links-to", "references", "embeds", "mentions")
RELATION_ALIASES = {
    "links-to": "links-to", "link": "links-to", "links": "links-to", "wikilink": "links-to", "backlink": "links-to",
    "references": "references", "reference": "references", "ref": "references",
    "embeds": "embeds", "embed": "embeds", "attachment": "embeds", "file": "embeds", "files": "embeds",
    "mentions": "mentions", "mention": "mentions", "author": "mentions",
}
#: Typed fields that extra front matter may not name.
CONTRACT_KEYS = ("title", "author", "tags", "aliases", "updated_at", "content_hash")
DEFAULT_COLLECTION = "vault"


def relation(name: str) -> str:
    """The relation of that name or alias; anything else is an error, not an empty answer."""
    if name not in RELATION_ALIASES:
        raise InvalidRequest(f"unknown relation {name!r}")
    return RELATION_ALIASES[name]


def document_id(value: str) -> str:
    """``value`` if it can name a document."""
    bad = not value or value != value.strip() or "\\" in value or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in value) or value.lower().endswith(".md")
    if bad or any(part in ("", ".", "..") for part in value.split("/")):
        raise InvalidRequest(f"bad document id {value!r}")
    return value


def bounded(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise InvalidRequest(f"{name} must be {low} to {high}, not {value}")
    return value
