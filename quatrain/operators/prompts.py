"""Code tables and prompt texts of the service, as broadcastable dimension tables and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Style codes and their names; other codes are the default.
STYLES = {
    "jueju": "绝句", "lvshi": "律诗", "ci": "宋词", "qu": "元曲", "sijo": "时调", "gasa": "歌辞",
    "sonnet": "十四行诗", "ode": "颂诗", "lyric": "抒情诗", "modern": "现代诗", "classical": "古典诗",
}
DEFAULT_STYLE = "现代诗"
LANGUAGES = {"KO": "韩语", "RU": "俄语"}
DEFAULT_LANGUAGE = "中文"
#: The styles that each language offers.
STYLES_OF = {"ZH": ("jueju", "lvshi", "ci", "qu", "modern"), "KO": ("sijo", "gasa", "modern"), "RU": ("sonnet", "ode", "lyric", "modern")}
#: Own wording: how far a rewriting may go.
INTENSITY = {
    1: "Stay with the source: wording, images and order are kept.",
    2: "Stay near the source; adjust wording where the form asks for it.",
    3: "Balance source and target form: keep meaning, recast lines.",
    4: "Rewrite freely in the target form; keep the theme and main images.",
    5: "Compose anew in the target tradition from the source's theme.",
}
#: Own wording: forms by style, where they do not depend on the language.
FORMS = {
    "jueju": "4 lines of 7 (or 5) characters; lines 2 and 4 share a level-tone rhyme",
    "lvshi": "8 lines of 7 characters; lines 2, 4, 6 and 8 share a level-tone rhyme; lines 3-4 and 5-6 are parallel",
    "ci": "a named tune pattern, with its line lengths and rhymes",
    "qu": "a named song pattern, plain language allowed",
    "sijo": "3 lines, 3-4-3-4 / 3-4-3-4 / 3-5-4-3 syllables, a turn in line 3",
    "gasa": "an even number of four-foot lines",
    "sonnet": "14 lines in a sonnet's rhyme scheme",
    "ode": "three or more quatrains, ABAB or AABB",
    "lyric": "8 lines, ABABCDCD",
}
MODERN = {"KO": "free Korean verse", "RU": "free Russian verse"}
CLASSICAL = {"KO": FORMS["sijo"], "RU": FORMS["lyric"]}


def lookup(table: Mapping, key: Column, default: str | None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return F.coalesce(found, F.lit(default))


def style_name(code: Column) -> Column:
    return lookup(STYLES, code, DEFAULT_STYLE)


def language_name(code: Column) -> Column:
    return lookup(LANGUAGES, code, DEFAULT_LANGUAGE)


def offered_styles(language: Column) -> Column:
    """Style codes that a language offers, in order; those of the first language for a code that is unknown."""
    listed = F.create_map(*[x for lang, codes in STYLES_OF.items() for x in (F.lit(lang), F.array(*map(F.lit, codes)))])
    return F.coalesce(F.try_element_at(listed, language), F.array(*map(F.lit, STYLES_OF["ZH"])))


def form_name(language: Column, style: Column) -> Column:
    modern = lookup(MODERN, language, "free Chinese verse")
    classical = lookup(CLASSICAL, language, FORMS["lvshi"])
    return F.when(style == "classical", classical).otherwise(F.coalesce(lookup(FORMS, style, None), modern))


def intensity_text(level: Column) -> Column:
    """No level, and one out of range, is 3."""
    return lookup(INTENSITY, F.coalesce(level.cast("int"), F.lit(3)), INTENSITY[3])


def target_language(source: Column, target: Column, languages: Sequence[str] = ("ZH", "KO", "RU")) -> Column:
    """A target that equals the source becomes the first other language."""
    others = F.array_remove(F.array(*[F.lit(x) for x in languages]), source)
    return F.when(target == source, F.get(others, F.lit(0))).otherwise(target)


def render_requests(requests: DataFrame) -> DataFrame:
    """text, style, source_lang, target_lang, intensity to requests with a prompt; blank texts are left out."""
    kept = requests.where(F.trim("text") != "")
    return kept.withColumn(
        "prompt",
        F.concat_ws(
            "\n",
            F.format_string("Rewrite this %s poem as a %s poem (%s).", language_name(F.col("source_lang")), language_name(F.col("target_lang")), style_name(F.col("style"))),
            F.concat(F.lit("Form: "), form_name(F.col("target_lang"), F.col("style"))),
            F.concat(F.lit("Freedom: "), intensity_text(F.col("intensity"))),
            F.lit("Answer with the parts 【转写结果】 and 【转写思路】."),
            F.col("text"),
        ),
    )


#: Fixed value: the shape in which a model has to answer.
ANSWER_SHAPE = """{
  "emotion": {"value": ["label"], "confidence": 0.0, "evidence": ["words of the poem"]},
  "diction": {"value": "label", "confidence": 0.0, "evidence": ["words of the poem"]},
  "expression": {"value": "label", "confidence": 0.0, "evidence": ["words of the poem"]},
  "energy": {"value": "label", "confidence": 0.0, "evidence": ["words of the poem"]}
}"""
LABEL_RULES = (
    "Give one or two of the allowed labels for emotion, and exactly one for each other dimension.",
    "Where two labels fit, give the one that rules the whole poem; only emotion may have two.",
    "confidence is a number from 0 to 1 that says how sure you are of the label, and does not judge the poem.",
    "evidence holds up to three short passages of the poem, word by word; nothing that does not stand there.",
    "Answer with one JSON object and nothing around it.",
)


def label_prompt(text: Column, taxonomy: Mapping[str, Mapping[str, str] | Sequence[str]], form: Column | None = None) -> Column:
    """Asks a model for labels: the form, the poem, each dimension's values with what they mean (if taxonomy says so), the
    rules and the shape of the answer. Author and title stay out, so they cannot sway it."""
    said = lambda v: "; ".join(f"{k}={x}" for k, x in v.items()) if isinstance(v, Mapping) else ", ".join(v)
    parts = [F.lit("Label the style of this classical poem for research. Judge by the text alone, and do not guess who wrote it.")]
    if form is not None:
        parts.append(F.concat(F.lit("Form: "), form))
    parts += [F.concat(F.lit("Poem:\n"), text), F.lit("Dimensions and values:\n" + "\n".join(f"{d}: {said(v)}" for d, v in taxonomy.items()))]
    parts += [F.lit("Rules:\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(LABEL_RULES, 1))), F.lit("Shape of the answer:\n" + ANSWER_SHAPE)]
    return F.concat_ws("\n\n", *parts)
