"""What is read out of a note's text and metadata, as Columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values here and below: the patterns of frontmatter, tags, links, days and metric references and keys.
LETTER = r"\p{IsAlphabetic}\p{N}"
FRONTMATTER = r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n?"
#: Files that instruct programs rather than hold notes; callers may name more.
NOISE = ("agents.md", "claude.md")


def frontmatter(raw: Column) -> Column:
    """The text between the fences at the start; null if there are none (an empty block has none)."""
    return F.when(raw.rlike(FRONTMATTER), F.regexp_extract(raw, FRONTMATTER, 1))


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONTMATTER, "")


def title(meta_title: Column, text: Column) -> Column:
    """The metadata's title, or the first line that starts with #, without its marks."""
    heading = F.regexp_extract(text, r"(?m)^[^\S\n]*#+[^\S\n]*(\S[^\n]*?)[^\S\n]*$", 1)
    return F.coalesce(F.nullif(F.trim(meta_title), F.lit("")), F.nullif(heading, F.lit("")))


def inline_tags(text: Column) -> Column:
    """Distinct sorted #tags; the sign may not follow a letter, digit, _, -, ! or [."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<![{LETTER}_\-!\[])#([{LETTER}_\-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def listed_tags(values: Column) -> Column:
    """Tags of a metadata value (array of strings, nested ones flattened): each split at commas and white space; # signs
    stay."""
    parts = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(v, r"[,\s]+")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))


def tag_union(text: Column, values: Column) -> Column:
    return F.array_sort(F.array_union(inline_tags(text), listed_tags(values)))


def aliases(values: Column) -> Column:
    """Aliases trimmed, blank ones dropped; null if none is left."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def wikilinks(text: Column) -> Column:
    """Trimmed insides of [[...]] that no ! precedes, distinct in their order."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?<!!)\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda r: F.trim(r)), lambda r: r != ""))


def parse_link(raw: Column) -> Column:
    """Struct of raw, target, display and heading: display after the first |, heading after the first #."""
    bar, left = F.instr(raw, "|"), F.substring_index(raw, "|", 1)
    sharp = F.instr(left, "#")
    none = F.lit(None).cast("string")
    return F.struct(
        raw.alias("raw"),
        F.nullif(F.trim(F.substring_index(left, "#", 1)), F.lit("")).alias("target"),
        F.when(bar > 0, F.nullif(F.trim(F.substr(raw, bar + 1)), F.lit(""))).otherwise(none).alias("display"),
        F.when(sharp > 0, F.nullif(F.trim(F.substr(left, sharp + 1)), F.lit(""))).otherwise(none).alias("heading"),
    )


DATE_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:\d{2})?)?$"


def instant(text: Column) -> Column:
    """The instant of a date literal, null if it is none; parts that a timestamp parser would fill in are not."""
    return F.when(text.rlike(DATE_TIME), F.try_to_timestamp(text))


def content_document(note_id: Column, title_: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", note_id, title_, text)


@F.pandas_udf(StringType())
def metadata_document(meta: pd.Series) -> pd.Series:
    """``key:value value`` lines of a metadata object given as JSON: arrays flattened, objects both whole and by path."""

    def walk(key, value):
        if isinstance(value, list):
            for v in value:
                yield from walk(key, v)
        elif isinstance(value, dict):
            whole = json.dumps(value, sort_keys=True, separators=(",", ":"))
            yield f"{key}:{whole} {whole}"
            for k in sorted(value):
                yield from walk(f"{key}.{k}", value[k])
        elif value is not None:
            text = value if isinstance(value, str) else json.dumps(value)
            yield f"{key}:{text} {text}"

    def one(text):
        data = json.loads(text) if text else {}
        return "\n".join(line for k in sorted(data) for line in walk(k, data[k]))

    return meta.map(one, na_action="ignore")


def embedding_text(title_: Column, metadata_lines: Column, tags: Column, text: Column) -> Column:
    """Title, sorted metadata lines, tags and body, each part only if there is any."""
    lines = F.when(F.size(metadata_lines) > 0, F.concat(F.lit("Metadata:\n"), F.array_join(F.array_sort(metadata_lines), "\n")))
    tag = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.concat_ws("\n\n", title_, lines, tag, F.nullif(text, F.lit("")))


def content_fingerprint(path: Column, metadata: Column, text: Column) -> Column:
    """SHA-256 over the path, the metadata (map of key to JSON) by key, and the body, with separators."""
    end = F.unhex(F.lit("FF"))
    keys = F.array_sort(F.map_keys(metadata))
    parts = F.transform(keys, lambda k: F.concat(F.lit("00"), F.hex(F.encode(k, "UTF-8")), F.lit("00"), F.hex(F.encode(F.element_at(metadata, k), "UTF-8"))))
    meta = F.unhex(F.array_join(parts, ""))
    return F.sha2(F.concat(F.encode(path, "UTF-8"), meta, end, F.encode(text, "UTF-8")), 256)


def excerpt(text: Column, size: int = 240) -> Column:
    """The first characters and dots, if the text has more bytes than that."""
    return F.when(F.octet_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def preview(text: Column, size: int = 240) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.char_length(t) > size, F.concat(F.left(t, F.lit(size)), F.lit("..."))).otherwise(t)


def best_window(hits: list[tuple[int, str]], tokens: int, size: int) -> int:
    """Where a window of ``size`` tokens begins that shows the most different words, then the most hits, of those that
    begin at a hit, the hits in its middle. ``hits``: place and word, in order."""
    best, start = -1, 0
    for k, (first, _) in enumerate(hits):
        inside = [h for h in hits[k:] if h[0] < first + size]
        score = 1000 * len({w for _, w in inside}) + len(inside)
        if score > best:
            best, start = score, max(0, min(first - (size - (inside[-1][0] - first) - 1) // 2, tokens - size))
    return start


@F.pandas_udf(StringType())
def snippet(text: pd.Series, words: pd.Series) -> pd.Series:
    """20 tokens of a text around its best hits of the query words (words or stems, joined by spaces), which are put in
    brackets; its first tokens if there is no hit."""
    import regex

    from .text import fold, porter

    def one(t, w):
        want = set((w or "").lower().split())
        spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}]+", t or "")]
        if not spans:
            return t or ""
        named = [(t[a:b].lower(), porter(fold(t[a:b].lower()))) for a, b in spans] if want else []
        hits = [(k, x if x in want else y) for k, (x, y) in enumerate(named) if x in want or y in want]
        first, at_hit = best_window(hits, len(spans), 20), {k for k, _ in hits}
        shown = spans[first : first + 20]
        out, at = "", shown[0][0]
        for k, (a, b) in enumerate(shown, first):
            out += t[at:a] + (f"[[{t[a:b]}]]" if k in at_hit else t[a:b])
            at = b
        return ("..." if first else "") + out + ("..." if first + 20 < len(spans) else "")

    return pd.Series([one(t, w) for t, w in zip(text, words)])


def note_dates(note_id: Column, meta_date: Column, *texts: Column) -> Column:
    """Distinct valid days named by the id, the metadata or anywhere in the texts."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)) for t in texts]))
    head = F.regexp_extract(note_id, r"^(\d{4}-\d{2}-\d{2})(?:$|[-_])", 1)
    every = F.transform(F.concat(F.array(head, F.coalesce(meta_date, F.lit(""))), found), lambda d: F.try_to_date(d))
    return F.array_sort(F.array_distinct(F.filter(every, lambda d: d.isNotNull())))


def metric_refs(text: Column) -> Column:
    """Ids after ``metric:``, trailing dots, colons and dashes trimmed, distinct in order."""
    found = F.regexp_extract_all(text, F.lit(r"metric:([A-Za-z0-9][A-Za-z0-9._:-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, r"[._:-]+$", "")))


def metric_keys(text: Column) -> Column:
    """Dotted lower-case keys that the text mentions, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+)\b"), F.lit(1)))


#: The naming classes and the patterns that decide them, in their order. A title is words that begin with
#: a capital and go on in small letters, hyphens and apostrophes.
NAMING = [
    ("ISO date (YYYY-MM-DD)", r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}$"),
    ("ISO week (YYYY-Www)", r"^\p{Nd}{4}-W\p{Nd}{2}$"),
    ("Numeric identifiers", r"^[0-9]+$"),
    ("kebab-case", r"^[a-z0-9]+(-[a-z0-9]+)+$"),
    ("snake_case", r"^[a-z0-9]+(_[a-z0-9]+)+$"),
    ("PascalCase", r"^([A-Z][a-z0-9]+){2,}$"),
    ("Title Case", r"^\p{IsUppercase}[\p{IsLowercase}'-]*(\s+\p{IsUppercase}[\p{IsLowercase}'-]*)*$"),
    ("Uppercase identifiers", r"^[A-Z0-9][A-Z0-9 _-]*$"),
]


def leaf(note_id: Column) -> Column:
    """The last part of an id's path."""
    return F.trim(F.element_at(F.split(note_id, "/"), -1))


def naming_class(name: Column) -> Column:
    """The first naming class that a leaf name falls into; the rest is Mixed, and an empty name Misc."""
    out = F.when(name == "", "Misc")
    for label, pattern in NAMING:
        out = out.when(name.rlike(pattern), label)
    return out.otherwise("Mixed")


def word_count(raw: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def similarity_text(title_: Column, tags: Column, text: Column, size: int = 512) -> Column:
    """Title and #tags, and the first 40 words of the body if there is but one of them; at most ``size`` bytes of UTF-8,
    cut before a character that does not fit."""
    tag = F.when(F.size(tags) > 0, F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))
    words = F.nullif(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), 1, 40), " "), F.lit(""))
    whole = F.concat_ws(" ", title_, tag, F.when(title_.isNull() | tag.isNull(), words))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(whole, "UTF-8"), 1, size).cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(whole) <= size, whole).otherwise(cut)
