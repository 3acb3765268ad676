"""Text predicates and scalars over message columns, all in Spark's own expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a reply that moves the talk to private messages says, in fewer than DM_WORDS words.
DM_REDIRECT = (
    r"(?i)(please\s+(dm|direct\s+message)|send\s+(us|a)\s+(dm|direct\s+message)"
    r"|click\s+here\s+to\s+chat|please\s+follow\s+(us\s+)?and\s+(dm|direct))"
)
DM_WORDS = 25
URL_ONLY = r"^\s*(https?://\S+\s*)+$"
#: White space with Unicode's spaces; Java's \s alone is ASCII.
SPACE = r"[\s\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"
OTHER_SCRIPT = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]"


def lower_or_empty(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit(""))


def tokens(c: Column) -> Column:
    """Lower-cased pieces between white space; an empty array for null."""
    return F.filter(F.split(lower_or_empty(c), SPACE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def mentions(c: Column) -> Column:
    """Lower-cased handles mentioned in a text, as often as they come; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"@({WORD}+)"), F.lit(1))
    return F.transform(found, F.lower)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def strip_leading_mentions(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"^(@{WORD}+[\s\p{{Z}}]*)+", ""))


def is_dm_redirect(c: Column) -> Column:
    return F.coalesce(c.rlike(DM_REDIRECT), F.lit(False)) & (word_count(c) < DM_WORDS)


def is_link_or_blank(c: Column) -> Column:
    return F.coalesce((strip(c) == "") | c.rlike(URL_ONLY), F.lit(True))


def block_key(c: Column) -> Column:
    """Records that may be near-copies share it: the first 15 characters, lower-cased, and the length by tens."""
    return F.struct(F.lower(F.substring(c, 1, 15)).alias("prefix"), F.floor(F.length(c) / 10).alias("tens"))


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The name of the first rule (name, pattern) that a text matches; null, or ``otherwise``, if none does or it is null."""
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def citations(c: Column) -> Column:
    """The entries of ``CITATIONS: [a, b]`` in a reply, without quotes and blanks."""
    inner = F.regexp_extract(c, r"(?i)CITATIONS:\s*\[([^\]]*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(x, r"^[\s\"']+|[\s\"']+$", ""))), lambda x: x != "")


def unfence(c: Column) -> Column:
    """A model's reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))


def json_array(c: Column) -> Column:
    """The JSON array in a model's reply: from its first ``[`` to its last ``]``, without a code fence; all of it if there is none."""
    bare = unfence(c)
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")), bare)


def fill(template: str, **values: Column) -> Column:
    """A text with its ``{name}`` places filled; doubled braces stand for themselves, null values for nothing."""
    parts = [p for text, name, _, _ in Formatter().parse(template) for p in ([F.lit(text)] if text else []) + ([F.coalesce(values[name].cast("string"), F.lit(""))] if name is not None else [])]
    return F.concat(*parts) if parts else F.lit("")


def iso_time(c: Column) -> Column:
    """A time written in ISO 8601, UTC if it names no zone; null for ``NaT``, blanks and anything else."""
    return F.trim(c).try_cast("timestamp")


def lenient_json(c: Column, field: str, pattern: str, default: Column) -> Column:
    """A field of a JSON reply; where the reply is malformed what the pattern finds, else the default."""
    bare = unfence(c)
    return F.coalesce(F.get_json_object(bare, f"$.{field}"), F.nullif(F.regexp_extract(bare, pattern, 1), F.lit("")), default)


def cache_key(provider: Column, model: Column, prompt: Column) -> Column:
    """SHA-256 of a call's canonical JSON: keys in order, one user message, no parameters."""
    quoted = F.to_json(F.struct(prompt.alias("content"), F.lit("user").alias("role")))
    body = F.concat(F.lit('{"messages":['), quoted, F.lit('],"model":"'), model, F.lit('","params":{},"provider":"'), provider, F.lit('"}'))
    return F.sha2(body, 256)


def call_key(provider: Column, model: Column, messages: Column, params: Column) -> Column:
    """SHA-256 of a call's canonical JSON, keys in order: any messages (array of structs content, role) and parameters (a map)."""
    body = F.struct(messages.alias("messages"), model.alias("model"), F.map_from_entries(F.array_sort(F.map_entries(params))).alias("params"), provider.alias("provider"))
    return F.sha2(F.to_json(body), 256)


def round_to(c: Column, digits: int) -> Column:
    """Rounded by arithmetic on doubles, so that every engine gives the same."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def draw(seed: int, *parts: Column) -> Column:
    """A pseudo-random whole number of 32 bits, the same in every engine: the first half of an MD5's half."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("bigint")
