"""Which charset a page's bytes are in (P15, X9): byte order mark, then the response header, then the page's own meta
tag, then the byte pattern. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.urls import decode_payload

#: Fixed: byte order marks (hex) and their charsets, the longer first.
MARKS = [("EFBBBF", "UTF-8"), ("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE")]
#: Fixed: names that mean another charset, as browsers read them. A header's ISO-8859-1 is what clients assume where none was
#: sent, so it counts for nothing there.
ALIASES = {"ISO-8859-1": "WINDOWS-1252", "ISO8859-1": "WINDOWS-1252", "LATIN1": "WINDOWS-1252", "LATIN-1": "WINDOWS-1252",
           "US-ASCII": "WINDOWS-1252", "ASCII": "WINDOWS-1252", "UTF8": "UTF-8", "CP1252": "WINDOWS-1252", "X-CP1251": "WINDOWS-1251"}
ASSUMED = ("ISO-8859-1", "ISO8859-1", "LATIN1", "LATIN-1")
#: A meta tag has to stand in the first bytes of a page.
META_BYTES = 4096


def _named(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)charset\s*=\s*[\"']?\s*([\w.:-]+)", 1)), F.lit(""))


def sniff(payload: Column, content_type: Column, charset: Column | None = None) -> Column:
    """The charset's upper-case name."""
    first = F.hex(F.substring(payload, 1, 4))
    mark = F.coalesce(*[F.when(F.startswith(first, F.lit(m)), F.lit(name)) for m, name in MARKS])
    header = F.coalesce(F.nullif(F.upper(F.trim(charset)), F.lit("")) if charset is not None else F.lit(None).cast("string"),
                        _named(content_type))
    header = F.when(~header.isin(*ASSUMED), header)
    head = F.decode(F.substring(payload, 1, META_BYTES), "ISO-8859-1")
    meta = _named(F.regexp_extract(head, r"(?is)<meta\b[^>]*?(charset\s*=\s*[\"']?\s*[\w.:-]+)", 1))
    # a page that can be read as ASCII is not in a two-byte charset, whatever its tag says
    meta = F.when(~F.startswith(F.coalesce(meta, F.lit("")), F.lit("UTF-16")), meta).otherwise(F.lit("UTF-8"))
    pattern = (F.when(first.rlike("^003C00"), "UTF-16BE").when(first.rlike("^3C00..00"), "UTF-16LE")
               .when(F.is_valid_utf8(payload.cast("string")), "UTF-8").otherwise("WINDOWS-1252"))
    name = F.coalesce(mark, header, F.when(meta != "", meta), pattern)
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), name)


def page_text(payload: Column, charset: Column) -> Column:
    """The page's characters in a charset that ``sniff`` names, without a byte order mark. Bytes that the charset does not
    have are replaced."""
    return F.regexp_replace(decode_payload(payload, charset), "^\ufeff", "")
