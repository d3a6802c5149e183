"""Text to bytes: comment stripping, character spans, pins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def strip_comments(column: str, begin: str = "$(", end: str = "$)"):
    """Without ``begin … end`` spans, white space squeezed line by line, empty lines
    dropped. A span that never ends is an error."""
    span = "(?s)" + re.escape(begin) + ".*?" + re.escape(end)
    bare = F.regexp_replace(F.col(column), span, "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " ")))
    out = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return F.when(F.instr(bare, begin) == 0, out).otherwise(F.raise_error("a comment never ends").cast("string"))


def byte_spans(column: str):
    """For each character its number, first byte and number of UTF-8 bytes."""
    chars = F.filter(F.split(F.col(column), ""), lambda c: c != "")
    places = F.transform(F.regexp_extract_all(F.hex(F.col(column)), F.lit("(..)"), 1), lambda h, i: F.when(~F.substring(h, 1, 1).isin("8", "9", "A", "B"), i))
    starts = F.filter(places, lambda i: i.isNotNull())
    return F.zip_with(chars, starts, lambda c, i: F.struct(c.alias("ch"), i.alias("first"), F.octet_length(c).alias("size")))


def pins(column: str) -> dict:
    """Digests and size of a text or binary column."""
    raw = F.col(column).cast("binary")
    return {"sha256": F.sha2(raw, 256), "md5": F.md5(raw), "sha1": F.sha1(raw), "size": F.octet_length(raw).cast("long")}
