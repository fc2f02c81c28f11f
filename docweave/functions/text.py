"""Column expressions for names, ids and display strings."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identity prefixes and display texts.
CANONICAL_PREFIX = "canonical:v1:"
EDGE_PREFIX = "canonical-edge:v1:"
PATH_PREFIX = "canonical-path:v1:"
COMMUNITY_PREFIX = "community:v1:"
DEFAULT_TITLE = "新会话"
TITLE_LENGTH = 20
REWRITE_LENGTH = 1000

_ASCII = r"^[\x00-\x7F]*$"
_BLANKS = r"[\s\x1c-\x1f]+"
_ASCII_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_UNICODE_BLANKS = (
    r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)
_URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
_MESSAGE_KEY_PREFIX = "docweave-message"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_ascii(column: Column | str) -> Column:
    return _col(column).rlike(_ASCII)


# Every character that counts as blank.
_BLANK_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(column: Column | str) -> Column:
    """Trim every blank that Unicode knows, not only the space character."""
    return F.btrim(_col(column), F.lit(_BLANK_CHARS))


@F.arrow_udf(T.StringType())
def _normalize_unicode(names: pa.Array) -> pa.Array:
    def one(name):
        if name is None:
            return None
        folded = unicodedata.normalize("NFKC", name).casefold()
        kept = (c for c in folded if unicodedata.category(c)[0] != "P")
        return " ".join("".join(kept).split())

    return pa.array(map(one, names.to_pylist()), pa.string())


@F.arrow_udf(T.StringType())
def _casefold_unicode(names: pa.Array) -> pa.Array:
    return pa.array([None if name is None else name.casefold().strip() for name in names.to_pylist()], pa.string())


def normalize_ascii(column: Column | str) -> Column:
    """Resolution key for names known to be ASCII; stays inside codegen."""
    bare = F.regexp_replace(F.lower(_col(column)), r"\p{P}", "")
    return F.trim(F.regexp_replace(bare, _BLANKS, " "))


def normalize_name(column: Column | str, ascii_only: bool = False) -> Column:
    """Resolution key: NFKC, casefold, no punctuation, single spaces.

    ASCII names are normalised by built-in expressions; the Arrow function only
    receives the others (as nulls otherwise), because Spark has no NFKC or casefold.
    """
    name = _col(column)
    if ascii_only:
        return normalize_ascii(name)
    plain = is_ascii(name)
    return F.coalesce(
        F.when(plain, normalize_ascii(name)), _normalize_unicode(F.when(~plain, name))
    )


def merge_key(column: Column | str, ascii_only: bool = False) -> Column:
    """Document-level merge key: casefold and strip only, punctuation kept."""
    name = _col(column)
    native = F.btrim(F.lower(name), F.lit(_ASCII_BLANKS))
    if ascii_only:
        return native
    plain = is_ascii(name)
    return F.coalesce(F.when(plain, native), _casefold_unicode(F.when(~plain, name)))


def canonical_id(normalized: Column | str) -> Column:
    """Identity of a canonical entity; depends on the normalised name only."""
    return F.concat(F.lit(CANONICAL_PREFIX), F.sha2(_col(normalized), 256))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Prefix plus the digest of the parts written as a compact JSON array."""
    return F.concat(
        F.lit(prefix), F.sha2(F.to_json(F.array(*[_col(p) for p in parts])), 256)
    )


def pack_canonical(canonical: str) -> Column:
    """A canonical id as bytes, the digest of ``canonical_id`` in half its digits; any other id as it is."""
    c = F.col(canonical)
    plain = (F.length(c) == len(CANONICAL_PREFIX) + 64) & c.startswith(CANONICAL_PREFIX) & (F.lower(c) == c)
    # What is no hexadecimal number has no bytes.
    digest = F.concat(F.unhex(F.lit("01")), F.unhex(F.substring(c, len(CANONICAL_PREFIX) + 1, 64)))
    return F.coalesce(F.when(plain, digest), F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def unpack_canonical(packed: str) -> Column:
    """The id that ``pack_canonical`` got."""
    rest = F.substring(F.col(packed), 2, 1 << 30)
    digest = F.concat(F.lit(CANONICAL_PREFIX), F.lower(F.hex(rest)))
    return F.when(F.substring(F.col(packed), 1, 1) == F.unhex(F.lit("01")), digest).otherwise(F.decode(rest, "UTF-8"))


def edge_id(source, target, relation_type) -> Column:
    return stable_id(EDGE_PREFIX, source, target, F.coalesce(_col(relation_type), F.lit("")))


def path_id(source, target, relation_type) -> Column:
    return stable_id(PATH_PREFIX, source, target, relation_type)


def community_id(members: Column | str) -> Column:
    ordered = F.array_sort(F.array_distinct(_col(members)))
    return F.concat(F.lit(COMMUNITY_PREFIX), F.sha2(F.to_json(ordered), 256))


def message_id(conversation, run, role) -> Column:
    """Name-based (version 5) UUID over conversation, run and role."""
    name = F.concat_ws(":", F.lit(_MESSAGE_KEY_PREFIX), _col(conversation), _col(run), _col(role))
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.lit("msg_"),
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        variant,
        F.substring(digest, 18, 15),
    )


def location_string(page="page", heading_path="heading_path", start="char_start", end="char_end"):
    """Readable position; absent parts are skipped."""
    path = _col(heading_path)
    return F.concat_ws(
        " · ",
        F.when(_col(page).isNotNull(), F.concat(F.lit("第"), _col(page).cast("string"), F.lit("页"))),
        F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, F.array_join(path, " > ")),
        F.concat(F.lit("字符 "), _col(start).cast("string"), F.lit("-"), _col(end).cast("string")),
    )


def derive_title(question, default: str = DEFAULT_TITLE) -> Column:
    compact = F.trim(F.regexp_replace(_col(question), _UNICODE_BLANKS, " "))
    short = F.substring(compact, 1, TITLE_LENGTH)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(default))


def rewrite_fallback(rewritten, original) -> Column:
    """Use the rewritten question unless it is blank or missing."""
    short = F.substring(py_strip(rewritten), 1, REWRITE_LENGTH)
    return F.coalesce(F.nullif(short, F.lit("")), _col(original))


def degree_tier(degree) -> Column:
    d = _col(degree)
    return F.when(d <= 0, "iso").when(d <= 2, "low").when(d <= 5, "mid").otherwise("hi")


def confidence_class(confidence) -> Column:
    c = _col(confidence).cast("double")
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return (
        F.when(~finite, "unknown").when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
    )


def role_map(role) -> Column:
    r = _col(role)
    return F.when(r == "agent", "assistant").otherwise(r)


def history_item(role, text) -> Column:
    return F.struct(role_map(role).alias("role"), _col(text).alias("content"))


CITATION_TYPE = (
    "array<struct<index:int,chunk_id:string,document_id:string,location:string,snippet:string>>"
)


def parse_citations(column) -> Column:
    """Stored JSON to an array of citations; null becomes an empty array."""
    return F.coalesce(F.from_json(_col(column), CITATION_TYPE), F.array().cast(CITATION_TYPE))


def format_citations(column) -> Column:
    """Array of citations to JSON; empty becomes null."""
    return F.when(F.size(_col(column)) > 0, F.to_json(_col(column)))
