"""Text expressions. White space is Unicode's, as (?U) classes it, unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of CJK and full-width characters, which count 1.5 tokens each; signs that end a sentence.
WIDE = "\\u3000-\\u303F\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\uFF00-\\uFFEF"
SENTENCE_END = "。？！.!?\n"
_WIDE = re.compile(f"[{WIDE}]")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def estimate_tokens(c: Column) -> Column:
    """1.5 for a wide character, 0.25 for any other, rounded up; null is 0."""
    c = F.coalesce(c, F.lit(""))
    rest = F.length(F.regexp_replace(c, f"[{WIDE}]", ""))
    return F.ceil(1.5 * (F.length(c) - rest) + 0.25 * rest).cast("long")


def sentences(c: Column) -> Column:
    """Parts that end with a sentence sign, which they keep; empty parts are left out."""
    return F.filter(F.split(c, f"(?<=[{SENTENCE_END}])"), lambda x: x != "")


def parse_tags(c: Column) -> Column:
    """Tags of the last line that reads `Tag: a, b`, in order, repeats kept; an empty array where there is none."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda x: x.rlike("(?U)^\\s*Tag\\s*[:：]\\s*\\S|^\\s*Tag\\s*[:：]\\s+$"))
    body = F.regexp_replace(F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")), "(?U)^\\s*Tag\\s*[:：]", "")
    tags = F.transform(F.split(body, "[,，、]"), lambda x: trim(F.regexp_replace(x, "(?U)\\s+", " ")))
    return F.filter(tags, lambda x: x != "")


def clean_tag(c: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(c, "[，、]", ", "), "(?U)\\s+", " "))


def sanitize_title(c: Column) -> Column:
    """A file-name part: without signs that paths can't hold, single blanks, no dots or blanks at the ends."""
    safe = F.regexp_replace(c, '[\\\\/:*?"<>|\\x00-\\x1F]', "")
    return F.regexp_replace(trim(F.regexp_replace(safe, "(?U)\\s+", " ")), "^\\.+|\\.+$", "")


def _nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return run(c)


def normalize_text(c: Column) -> Column:
    """NFKC, one kind of line end, single blanks, two line ends at most, trimmed, lower case. NFKC is the one step that
    Spark has no function for; ASCII texts, which it can't change, don't leave the JVM's result."""
    c = F.when(c.rlike("[^\\x00-\\x7F]"), _nfkc(c)).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    return F.lower(trim(F.regexp_replace(c, "\n{3,}", "\n\n")))


def normalize_path(c: Column) -> Column:
    return F.lower(F.replace(trim(c), F.lit("\\"), F.lit("/")))


def occurrences(c: Column, target: Column) -> Column:
    """How often target stands in c without overlaps; an empty target stands nowhere."""
    return F.when(F.length(target) == 0, 0).otherwise((F.length(c) - F.length(F.replace(c, target, F.lit("")))) / F.length(target)).cast("long")


def hash_embedding(c: Column, dimension: int = 8) -> Column:
    """A stand-in for an embedding service: element code point % dimension gains the code point."""
    zeros = F.array_repeat(F.lit(0.0), dimension)
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    return F.aggregate(points, zeros, lambda v, p: F.transform(v, lambda x, i: F.when(i == p % dimension, x + p).otherwise(x)))


def message_text(parts: Column) -> Column:
    """The text of a message of several parts, array<struct<type, text>>: those of type text, joined."""
    said = F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.coalesce(F.array_join(F.transform(said, lambda p: p["text"]), ""), F.lit(""))


def is_technical(c: Column) -> Column:
    return ~c.rlike("[\\u4e00-\\u9fa5]") & c.rlike("^[A-Za-z0-9\\-_.\\s]+$")


def notation(name: Column, tag_id: Column, weight: Column, source: Column, hop: Column) -> Column:
    """=tag:0.74@seed, ~tag:0.12@emergent:2, #id for a tag without a name."""
    token = F.concat(F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("#"), tag_id)).otherwise(name), F.lit(":"), F.format_string("%.2f", weight))
    return F.when(source == "emergent", F.concat(F.lit("~"), token, F.lit("@emergent:"), hop)).otherwise(F.concat(F.lit("="), token, F.lit("@"), source))


# --- chunks: sequential by nature, so Python over Arrow batches


def _weight(text: str) -> float:
    wide = len(_WIDE.findall(text))
    return 1.5 * wide + 0.25 * (len(text) - wide)


def forced_slices(text: str, max_tokens: float) -> list[str]:
    """Longest prefixes within max_tokens, cut back to the last punctuation mark where there is one."""
    out, start = [], 0
    while start < len(text):
        total, end = 0.0, start
        while end < len(text) and total + (w := 1.5 if _WIDE.match(text[end]) else 0.25) <= max_tokens:
            total, end = total + w, end + 1
        if end == start:
            end += 1
        elif end < len(text):
            marks = [i for i in range(start + 1, end) if text[i] in "。？！.!?,，、;；:：\n"]
            end = marks[-1] + 1 if marks else end
        out.append(text[start:end])
        start = end
    return out


def chunks(text: str | None, max_tokens: int = 6800, overlap_tokens: int = 680) -> list[str]:
    """Whole sentences packed greedily; a chunk begins with the last sentences of the one before, as far as the overlap
    and the next sentence allow. A sentence above max_tokens is sliced into chunks of its own."""
    out: list[str] = []
    held: list[tuple[str, float]] = []
    total = 0.0

    def close() -> None:
        if joined := "".join(s for s, _ in held).strip():
            out.append(joined)

    for sentence in re.findall(f"[^{SENTENCE_END}]*[{SENTENCE_END}]|[^{SENTENCE_END}]+", text or ""):
        if not sentence.strip():
            continue
        weight = _weight(sentence)
        if weight > max_tokens:
            close()
            held, total = [], 0.0
            out += [p.strip() for p in forced_slices(sentence, max_tokens) if p.strip()]
            continue
        if total + weight > max_tokens:
            close()
            room, kept, total = min(overlap_tokens, max_tokens - weight), 0, 0.0
            while kept < len(held) and total < room and total + held[-1 - kept][1] <= room:
                total += held[-1 - kept][1]
                kept += 1
            held = held[len(held) - kept :]
        held.append((sentence, weight))
        total += weight
    close()
    return out


def chunk_text(c: Column, max_tokens: int = 6800, overlap_tokens: int = 680) -> Column:
    @F.pandas_udf("array<string>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield s.map(lambda x: chunks(x, max_tokens, overlap_tokens))

    return run(c)
