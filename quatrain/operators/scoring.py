"""Verse scores: form, rhyme, parallel lines and their weighted sum. Narrow projections, no shuffle.

How signs are read comes from one of three: Pronunciation, a small table that becomes a map literal; JoinedSounds, a column
that pronounce.with_sounds has joined from a table of any size; LastSign, for scripts that are spelled as they sound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quatrain.functions import text as X

#: Each final's rhyme group in the fourteen-group scheme.
RHYME_GROUPS = {
    "a": "1麻", "ia": "1麻", "ua": "1麻",
    "o": "2波", "e": "2波", "uo": "2波",
    "ie": "3皆", "üe": "3皆", "ve": "3皆",
    "ai": "4开", "uai": "4开",
    "ei": "5微", "ui": "5微", "uei": "5微",
    "ao": "6豪", "iao": "6豪",
    "ou": "7尤", "iu": "7尤", "iou": "7尤",
    "an": "8寒", "ian": "8寒", "uan": "8寒", "üan": "8寒", "van": "8寒",
    "en": "9文", "in": "9文", "un": "9文", "ün": "9文", "vn": "9文",
    "ang": "10唐", "iang": "10唐", "uang": "10唐",
    "eng": "11庚", "ing": "11庚", "ong": "11庚", "iong": "11庚", "ueng": "11庚",
    "i": "12齐", "er": "12齐", "ü": "12齐", "v": "12齐",
    "u": "14姑",
}
LOOSE = {"uang": "ang", "iang": "ang"}
#: Fixed value: syllables whose final i is a group of its own.
BUZZING = "^(zh|ch|sh|r|z|c|s).\\z"


def _with_lines(text: Column, body) -> Column:
    """body(raw lines, clean lines), each computed once; no lines for null."""
    none = F.array().cast("array<string>")
    return X.let(F.coalesce(X.raw_lines(text), none), lambda raw: X.let(F.transform(raw, X.clean_line), lambda lines: body(raw, lines)))


def check_form(text: Column, n_lines: int, n_chars: int) -> Column:
    """ok, score, lines_raw, lines_clean, details; a score only where the number of lines is right."""
    return _with_lines(text, lambda raw, lines: _form(text, raw, lines, n_lines, n_chars))


def _form(text: Column, raw: Column, lines: Column, n_lines: int, n_chars: int) -> Column:
    sizes = lambda c: F.transform(c, F.length)

    share = F.aggregate(sizes(lines), F.lit(0.0), lambda a, n: a + F.greatest(F.lit(0.0), 1.0 - F.abs(n - n_chars) / F.lit(float(n_chars)))) / n_lines
    wrong = F.filter(F.transform(lines, lambda x, i: F.when(F.length(x) != n_chars, F.concat(F.lit("("), i + 1, F.lit(","), F.length(x), F.lit(")")))), lambda x: x.isNotNull())
    blank = ~F.coalesce(X.strip(text) != "", F.lit(False))
    right = F.size(lines) == n_lines

    def judged(wrong: Column) -> Column:
        good = right & (F.size(wrong) == 0)
        return F.struct(
            (~blank & good).alias("ok"),
            F.when(blank | ~right, 0.0).when(good, 1.0).otherwise(share).alias("score"),
            raw.alias("lines_raw"),
            lines.alias("lines_clean"),
            F.when(blank, "Empty text")
            .when(~right, F.concat(F.lit(f"Expected {n_lines} lines, got "), F.size(lines)))
            .when(good, "OK")
            .otherwise(F.concat(F.lit("Wrong lengths: "), F.array_join(wrong, ",")))
            .alias("details"),
        )

    return X.let(wrong, judged)


def _lookup(table: Mapping[str, object], key: Column, kind: str) -> Column:
    if not table:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key).cast(kind)


def normal_final(final: Column, mode: str, syllable: Column | None = None) -> Column:
    """strict: as it is; loose: two finals merged; xinyun: groups, with the buzzing i apart where a syllable is given."""
    low = F.lower(X.strip(final))
    if mode == "loose":
        return F.coalesce(_lookup(LOOSE, low, "string"), low)
    if mode == "xinyun":
        group = F.coalesce(_lookup(RHYME_GROUPS, low, "string"), low)
        return group if syllable is None else F.when((low == "i") & F.coalesce(syllable.rlike(BUZZING), F.lit(False)), "13支").otherwise(group)
    return low


class _BySign:
    """Reads a line's last sign by itself."""

    def at(self, lines: Column, place: int) -> tuple[Column, Column, Column]:
        """final, tone and syllable of the last sign of the line at a 1-based place."""
        c = X.last_char(F.get(lines, F.lit(place - 1)))
        return self.final(c), self.tone(c), self.syllable(c)


class JoinedSounds:
    """What pronounce.with_sounds has joined."""

    def __init__(self, column: str = "sounds"):
        self.column = column

    def at(self, lines: Column, place: int) -> tuple[Column, Column, Column]:
        found = F.try_element_at(F.col(self.column), F.lit(place))
        return found["final"], found["tone"].cast("int"), found["syllable"]


class Pronunciation(_BySign):
    """A small table of characters: final, tone and syllable of each. Others are unknown."""

    def __init__(self, table: Mapping[str, tuple[str, int, str]]):
        self.table = dict(table)

    def final(self, c: Column) -> Column:
        return _lookup({k: v[0] for k, v in self.table.items()}, c, "string")

    def tone(self, c: Column) -> Column:
        return _lookup({k: v[1] for k, v in self.table.items()}, c, "int")

    def syllable(self, c: Column) -> Column:
        return _lookup({k: v[2] for k, v in self.table.items()}, c, "string")


class LastSign(_BySign):
    """Rhyme by spelling: a line's last sign is its own final. For scripts without a table."""

    def final(self, c: Column) -> Column:
        return F.lower(c)

    def tone(self, c: Column) -> Column:
        return F.lit(None).cast("int")

    def syllable(self, c: Column) -> Column:
        return F.lower(c)


def check_two_rhymes(text: Column, sounds, mode: str = "strict") -> Column:
    """Lines 2 and 4 rhyme; more lines are fine. Finals are grouped without their syllable here."""
    return X.let(X.clean_lines(text), lambda lines: _two_rhymes(lines, sounds, mode))


def _two_rhymes(lines: Column, sounds, mode: str) -> Column:
    def judged(lines: Column) -> Column:
        last2, last4 = X.last_char(F.get(lines, F.lit(1))), X.last_char(F.get(lines, F.lit(3)))
        f2, f4 = sounds.at(lines, 2)[0], sounds.at(lines, 4)[0]
        n2, n4 = normal_final(f2, mode), normal_final(f4, mode)
        few = F.size(lines) < 4
        no_char, no_final = last2.isNull() | last4.isNull(), f2.isNull() | f4.isNull()
        ok = ~few & ~no_char & ~no_final & (n2 == n4)
        shown = lambda f, n: f if mode == "strict" else F.concat(f, F.lit("->"), n)
        both = few | no_char
        return F.struct(
            F.coalesce(ok, F.lit(False)).alias("ok"),
            F.when(ok, 1.0).otherwise(0.0).alias("score"),
            F.when(~both, F.when(no_final, f2).otherwise(shown(f2, n2))).alias("finals_2"),
            F.when(~both, F.when(no_final, f4).otherwise(shown(f4, n4))).alias("finals_4"),
            F.when(~few, last2).alias("last_2"),
            F.when(~few, last4).alias("last_4"),
            F.when(few, F.concat(F.lit("Need >=4 lines for rhyme check, got "), F.size(lines)))
            .when(no_char, "Empty last char in line 2 or 4")
            .when(no_final, "Failed to get finals for last chars")
            .when(ok, "OK")
            .otherwise(F.concat(F.lit("Rhyme mismatch: "), n2, F.lit(" / "), n4))
            .alias("details"),
        )

    return judged(lines)


def check_rhymes(text: Column, sounds, positions: Sequence[int] = (2, 4, 6, 8), mode: str = "strict", require_level: bool = False) -> Column:
    """Lines at 1-based positions rhyme with the first of them: ok, score, finals, tones, ping_ok, details. The score is
    the share that matches, the anchor included; level tones bear on ok only if they are required."""
    return X.let(X.clean_lines(text), lambda lines: _rhymes(lines, sounds, positions, mode, require_level))


def _rhymes(lines: Column, sounds, positions: Sequence[int], mode: str, require_level: bool) -> Column:
    n = len(positions)

    def judged(lines: Column) -> Column:
        chars = [X.last_char(F.get(lines, F.lit(p - 1))) for p in positions]
        finals, tones, syllables = zip(*[sounds.at(lines, p) for p in positions], strict=True)
        norms = [normal_final(f, mode, s) for f, s in zip(finals, syllables, strict=True)]
        size = F.size(lines)
        absent = F.filter(F.array(*[F.when((size < p) | F.lit(p < 1), p) for p in positions]), lambda x: x.isNotNull())
        missing = F.size(absent) > 0
        unknown = finals[0].isNull()
        for f in finals[1:]:
            unknown = unknown | f.isNull()
        matches = sum((F.when(x == norms[0], 1).otherwise(0) for x in norms[1:]), F.lit(1))
        level = F.lit(True)
        for t in tones:
            level = level & F.coalesce(X.is_level_tone(t), F.lit(False))
        bad = missing | unknown
        fits = ~bad & (matches == n) & (level | F.lit(not require_level))
        held = lambda xs, kind: F.when(~missing, F.map_from_arrays(F.array(*[F.lit(p) for p in positions]), F.array(*xs))).cast(f"map<int,{kind}>")
        return F.struct(
            fits.alias("ok"),
            F.when(bad, 0.0).otherwise(matches / F.lit(float(n))).alias("score"),
            held(chars, "string").alias("last_chars"),
            held(finals, "string").alias("finals"),
            held(norms, "string").alias("norm_finals"),
            held(tones, "int").alias("tones"),
            (~bad & level).alias("ping_ok"),
            F.when(missing, F.concat(F.lit("Need lines at positions "), F.array_join(absent.cast("array<string>"), ","), F.lit(", got "), size))
            .when(unknown, "Failed to get finals for some last chars")
            .when(matches < n, "Rhyme mismatch")
            .when(fits, "OK")
            .otherwise("Rhyme ok but not all level-tone")
            .alias("details"),
        )

    return judged(lines)


def check_pair(a: Column, b: Column, threshold: float = 0.6, tags: Column | None = None) -> Column:
    """Two lines differ sign by sign. tags: an optional score of equal parts of speech, averaged in where not null."""

    def judged(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        empty = F.coalesce((x == "") | (y == ""), F.lit(True))
        unequal = F.length(x) != F.length(y)
        signs = lambda c: F.filter(F.split(c, ""), lambda s: s != "")
        differ = F.size(F.filter(F.zip_with(signs(x), signs(y), lambda p, q: p != q), lambda d: d)) / F.length(x)
        own = tags if tags is not None else F.lit(None).cast("double")
        score = F.when(own.isNull(), differ).otherwise((differ + own) / 2)
        bad = empty | unequal
        return F.struct(
            (~bad & (score >= threshold)).alias("ok"),
            F.when(bad, 0.0).otherwise(score).alias("score"),
            F.when(bad, 0.0).otherwise(differ).alias("diff_score"),
            F.when(~bad, own).alias("pos_score"),
            F.when(empty, "Empty line").when(unequal, F.concat(F.lit("Length mismatch: "), F.length(x), F.lit(" vs "), F.length(y))).otherwise("OK").alias("details"),
        )

    return X.let(F.struct(X.clean_line(X.strip(a)).alias("x"), X.clean_line(X.strip(b)).alias("y")), judged)


def _agreement(tags: Column, a: int, b: int) -> Column:
    """The share of words of two lines that have the same part of speech (first letter of the tag). Null if the lines do
    not have equally many words, or none."""
    first = lambda p: F.transform(F.get(tags, F.lit(p - 1)), lambda t: F.left(t, F.lit(1)))

    def share(s: Column) -> Column:
        same = F.size(F.filter(F.zip_with(s["x"], s["y"], lambda p, q: p == q), lambda d: d))
        return F.when((F.size(s["x"]) == F.size(s["y"])) & (F.size(s["x"]) > 0), same / F.size(s["x"]))

    return X.let(F.struct(first(a).alias("x"), first(b).alias("y")), share)


def check_parallel(
    text: Column, pairs: Sequence[tuple[int, int]] = ((3, 4), (5, 6)), names: Sequence[str] = ("颔联", "颈联"), threshold: float = 0.6, tags: Column | None = None
) -> Column:
    """Pairs of lines are parallel: ok (all), score (mean), pairs by name; none if a line is missing. tags: parts of
    speech of the words of each line, as words.with_tags gives them; with it the share of equal parts is averaged in."""
    return X.let(X.raw_lines(text), lambda lines: _parallel(lines, pairs, names, threshold, tags))


def _parallel(lines: Column, pairs: Sequence[tuple[int, int]], names: Sequence[str], threshold: float, tags: Column | None) -> Column:
    last = max(p for pair in pairs for p in pair)
    few = F.size(lines) < last
    line = lambda k: F.get(lines, F.lit(k - 1))
    found = F.array(*[check_pair(line(a), line(b), threshold, _agreement(tags, a, b) if tags is not None else None) for a, b in pairs])

    def judged(each: Column) -> Column:
        total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x["score"]) / len(pairs)
        held = F.map_from_arrays(F.when(few, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, names))), F.when(few, F.slice(each, 1, 0)).otherwise(each))
        return F.struct((~few & F.forall(each, lambda x: x["ok"])).alias("ok"), F.when(few, 0.0).otherwise(total).alias("score"), held.alias("pairs"))

    return X.let(found, judged)


def _totals(parts: Column, names: Sequence[str], weights: Sequence[float]) -> Column:
    """ok (of all) and weighted total of parts, with each part's score."""

    def summed(p: Column) -> Column:
        ok, total = p[names[0]]["ok"], weights[0] * p[names[0]]["score"]
        for n, w in zip(names[1:], weights[1:], strict=True):
            ok, total = ok & p[n]["ok"], total + w * p[n]["score"]
        scores = [(p[n]["score"] if n in names else F.lit(None).cast("double")).alias(f"{n}_score") for n in ("meter", "rhyme", "parallel")]
        return F.struct(ok.alias("ok"), total.alias("total"), *scores)

    return X.let(parts, summed)


def score_quatrain(text: Column, sounds, mode: str = "strict", n_chars: int = 7, weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    def scored(raw: Column, lines: Column) -> Column:
        parts = F.struct(_form(text, raw, lines, 4, n_chars).alias("meter"), _two_rhymes(lines, sounds, mode).alias("rhyme"))
        return _totals(parts, ("meter", "rhyme"), weights)

    return _with_lines(text, scored)


def score_regulated(
    text: Column, sounds, mode: str = "strict", require_level: bool = False, n_chars: int = 7, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), tags: Column | None = None
) -> Column:
    def scored(raw: Column, lines: Column) -> Column:
        parts = F.struct(
            _form(text, raw, lines, 8, n_chars).alias("meter"),
            _rhymes(lines, sounds, (2, 4, 6, 8), mode, require_level).alias("rhyme"),
            _parallel(raw, ((3, 4), (5, 6)), ("颔联", "颈联"), 0.6, tags).alias("parallel"),
        )
        return _totals(parts, ("meter", "rhyme", "parallel"), weights)

    return _with_lines(text, scored)


def score_poem(text: Column, form: Column, sounds, **options) -> Column:
    """By form; an unknown form is an error."""
    return (
        F.when(form == "qijue7", score_quatrain(text, sounds, **{k: v for k, v in options.items() if k in ("mode", "n_chars")}))
        .when(form == "qilv7", score_regulated(text, sounds, **options))
        .otherwise(F.raise_error(F.concat(F.lit("unknown form: "), F.coalesce(form, F.lit("null")))).cast("struct<ok:boolean,total:double,meter_score:double,rhyme_score:double,parallel_score:double>"))
    )
