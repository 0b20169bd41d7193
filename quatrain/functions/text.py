"""Text expressions: white space, lines, signs, scripts, identifiers and small parsers, all as JVM-side columns.

White space is Unicode's plus U+001C to U+001F, and lines end at every Unicode line boundary; Spark's own trim() and \\s
know ASCII blanks only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x{1c}-\x{1f}]"
#: The same signs, for trimming: every white space of Unicode, and U+001C to U+001F.
BLANK_SIGNS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: where lines end.
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
RARE_BREAK = r"[\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
#: The signs at which verse is cut, and the signs that a cleaned line lacks.
VERSE_BREAK = "[，。！？；：,.!?;:\n\r]+"
LINE_SIGNS = "，。！？；：、,.!?;:\"'“”‘’（）()[]{}《》<>…—-"
#: Ranges that count as Han.
HAN_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x3134F))
HAN = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in HAN_RANGES) + "]"
#: Letters that count as Cyrillic, and syllables that count as Hangul.
CYRILLIC, HANGUL = "[А-Яа-яЁё]", "[가-힣]"


def _class_of(signs: str) -> str:
    return "".join("\\" + s if s in "\\[]^-&" else s for s in signs)


_LATIN, _OTHERS = ("".join(c for c in LINE_SIGNS + BLANK_SIGNS if (ord(c) < 256) == latin) for latin in (True, False))
#: A Latin sign fails the first class by one look and the second by its range, so the long class is for others only.
CLEAN = f"(?:[{_class_of(_LATIN)}]|(?![\\x00-\\xff])[{_class_of(_OTHERS)}])+"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_SIGNS))


def remove_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){BLANK}+", "")


def raw_lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    # most texts have line feeds only, and cutting at one sign needs no pattern
    cut = F.when(text.rlike(RARE_BREAK), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def clean_line(line: Column) -> Column:
    return F.regexp_replace(line, CLEAN, "")


def clean_lines(text: Column) -> Column:
    """Lines without signs and blanks. A line of signs only stays, as an empty one."""
    return F.transform(raw_lines(text), clean_line)


def last_char(line: Column) -> Column:
    return F.when(F.length(line) > 0, F.right(line, F.lit(1)))


def verse_lines(paragraphs: Column) -> Column:
    """Paragraphs cut at punctuation, blanks removed, empty pieces dropped, in order."""
    pieces = F.transform(paragraphs, lambda p: F.filter(F.transform(F.split(p, VERSE_BREAK), remove_blanks), lambda x: x != ""))
    return F.flatten(F.filter(pieces, lambda x: x.isNotNull()))


def is_han(c: Column) -> Column:
    return c.rlike(f"^{HAN}\\z")


def is_exact_han(line: Column, chars: int = 7) -> Column:
    return line.rlike(f"^{HAN}{{{chars}}}\\z")


def is_russian(text: Column) -> Column:
    """Three Cyrillic letters, or more than three tenths of the signs that are not spaces."""
    n = F.regexp_count(text, F.lit(CYRILLIC))
    return (n >= 3) | ((n > 0) & (n / F.greatest(F.lit(1), F.length(F.replace(text, F.lit(" "), F.lit("")))) > 0.3))


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL)


def or_blank(c: Column, stripped: bool = True) -> Column:
    """The value as text; null, zero and false count as nothing."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s.isin("0", "0.0", "false"), "").otherwise(s)
    return strip(s) if stripped else s


def stable_id(source_id: Column, text: Column, prefix: str = "tang") -> Column:
    return F.when(F.coalesce(source_id, F.lit("")) != "", F.concat(F.lit(f"{prefix}-"), source_id)).otherwise(
        F.concat(F.lit(f"{prefix}-sha1-"), F.substring(F.sha1(text), 1, 16))
    )


def author_of(author: Column, unknown: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(strip(author), F.lit("")), F.lit(unknown))


def shard_number(path: Column, pattern: str = r"poet\.tang\.(\d+)\.json$") -> Column:
    """Number in a shard's file name; files without one come last."""
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", found.cast("bigint")).otherwise(F.lit(9223372036854775807))


def ascii_url(url: Column, query_too: bool = True) -> Column:
    """Percent-encode what is not ASCII-safe in the path (and the query), once."""
    quote = lambda c, keep: F.aggregate(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in keep]), F.replace(F.url_encode(F.try_url_decode(c)), F.lit("+"), F.lit("%20")), lambda s, r: F.replace(s, r["a"], r["b"])
    )
    head, rest = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    path = quote(F.replace(rest, F.lit("+"), F.lit("%2B")), [("%2F", "/"), ("%7E", "~"), ("%2B", "%2B")])
    kept = [("%3D", "="), ("%26", "&"), ("%3F", "?"), ("%2F", "/"), ("%3A", ":")]
    return F.concat(head, path, quote(F.replace(query, F.lit("+"), F.lit("%2B")), kept) if query_too else query)


def tone_number(syllable: Column) -> Column:
    """Last digit of a syllable; none is 0."""
    return F.coalesce(F.nullif(F.regexp_extract(syllable, r"(\d)\D*$", 1), F.lit("")).cast("int"), F.lit(0))


def is_level_tone(tone: Column) -> Column:
    return tone.isin(1, 2)


def json_object_in(text: Column) -> Column:
    """The JSON object in a model's answer (variant): in a code fence, bare, or between the outer braces; null if none."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    inner = F.when((first > 0) & (last >= first), F.substring(bare, first, last - first + 1))
    parsed = F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def section_between(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, stripped; the whole text where the first is missing."""
    found = F.regexp_extract(text, f"(?s){start}\\s*(.*?)(?={end}|\\z)", 1)
    return F.when(F.instr(text, start) > 0, strip(found)).otherwise(text)


def parse_names(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")


def unknown_names(raw: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(parse_names(raw), F.array(*[F.lit(a) for a in allowed]))
