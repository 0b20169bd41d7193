"""Operators over inputs that are written out (verses, answers, paragraphs, shards), against rows that the rules give."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quatrain.functions import text as X
from quatrain.operators import annotate, forms, lexicon, prompts, sampling, scoring, segment
from quatrain.operators.words import with_tags
from quatrain.sources import parse_shards

CASES = {}


def expect(columns: str, rows: list[tuple]):
    def add(f):
        CASES[f.__name__] = f, columns.split(", "), rows
        return f

    return add


def shown(rows):
    return sorted(tuple(repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["regulated_scores", "quatrain_scores", "tagged_pairs", "rhyme_groups", "tone_numbers", "script_predicates", "shard_records", "first_shards", "answer_validation", "run_counters", "two_form_sample", "sample_metadata", "korean_entries", "russian_entries", "numbered_entries", "longest_terms", "encoded_urls", "record_checks", "style_tables"])
def test_rows(spark, name):
    make, columns, rows = CASES[name]
    df = make(spark)
    assert sorted(df.columns) == sorted(columns)
    assert shown(df.select(*columns).collect()) == shown(rows)


#: Public-domain poems of the Tang.
CRANE = "昔人已乘黄鹤去\n此地空余黄鹤楼\n黄鹤一去不复返\n白云千载空悠悠\n晴川历历汉阳树\n芳草萋萋鹦鹉洲\n日暮乡关何处是\n烟波江上使人愁"
HEIGHT = "风急天高猿啸哀\n渚清沙白鸟飞回\n无边落木萧萧下\n不尽长江滚滚来\n万里悲秋常作客\n百年多病独登台\n艰难苦恨繁霜鬓\n潦倒新停浊酒杯"
DAWN = "朝辭白帝彩雲間\n千里江陵一日還\n兩岸猿聲啼不住\n輕舟已過萬重山"
#: Final, tone and syllable of the signs that lines of these poems end with.
SOUNDS = {
    "楼": ("ou", 2, "lou"), "悠": ("iou", 1, "you"), "洲": ("ou", 1, "zhou"), "愁": ("ou", 2, "chou"),
    "回": ("uei", 2, "hui"), "来": ("ai", 2, "lai"), "台": ("ai", 2, "tai"), "杯": ("ei", 1, "bei"),
    "還": ("uan", 2, "huan"), "山": ("an", 1, "shan"), "去": ("ü", 4, "qu"), "間": ("ian", 1, "jian"),
}
SHORT = "\n".join(x[:6] if i == 1 else x for i, x in enumerate(DAWN.split("\n")))


def _verses(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, text string")


REGULATED = [("crane", CRANE), ("height", HEIGHT), ("six", "\n".join(HEIGHT.split("\n")[:6])), ("twin", HEIGHT.replace("不尽长江滚滚来", "无边落木萧萧下")), ("none", None)]


@expect(
        "name, ok, total, meter_score, rhyme_score, level, parallel_score, details",
        [
            ("crane", True, 1.0, 1.0, 1.0, True, 1.0, "OK"),
            ("height", False, 0.85, 1.0, 0.5, True, 1.0, "OK"),
            ("six", False, 0.2, 0.0, 0.0, False, 1.0, "Expected 8 lines, got 6"),
            # the second line of the pair no longer rhymes: its last sign is unknown
            ("twin", False, 0.6, 1.0, 0.0, False, 0.5, "OK"),
            ("none", False, 0.0, 0.0, 0.0, False, 0.0, "Empty text"),
        ],
)
def regulated_scores(spark):
    sounds = scoring.Pronunciation(SOUNDS)
    text = F.col("text")
    scored = _verses(spark, REGULATED).select(
        "name", scoring.score_regulated(text, sounds, "xinyun").alias("s"), scoring.check_rhymes(text, sounds, mode="xinyun").alias("r"), scoring.check_form(text, 8, 7).alias("f")
    )
    return scored.select("name", "s.ok", F.bround("s.total", 6).alias("total"), "s.meter_score", "s.rhyme_score", F.coalesce("r.ping_ok", F.lit(False)).alias("level"), "s.parallel_score", "f.details")


@expect(
        "name, mode, meter, rhyme_ok, total",
        [("dawn", "strict", 1.0, False, 0.7), ("dawn", "loose", 1.0, False, 0.7), ("dawn", "xinyun", 1.0, True, 1.0)]
        + [("short", m, 0.964286, False, 0.675) for m in ("strict", "loose", "xinyun")]
        + [("three", m, 0.0, False, 0.0) for m in ("strict", "loose", "xinyun")]
        + [("blank", m, 0.0, False, 0.0) for m in ("strict", "loose", "xinyun")],
)
def quatrain_scores(spark):
    """Lines 2 and 4 end in 還 and 山: equal in the fourteen groups only; the short poem's second line ends in 日."""
    sounds, text = scoring.Pronunciation(SOUNDS), F.col("text")
    docs = _verses(spark, [("dawn", DAWN), ("short", SHORT), ("three", "\n".join(DAWN.split("\n")[:3])), ("blank", " \n　")])
    each = F.array(*[F.struct(F.lit(m).alias("mode"), scoring.score_quatrain(text, sounds, m).alias("s")) for m in ("strict", "loose", "xinyun")])
    rows = docs.select("name", F.explode(each).alias("x"))
    return rows.select("name", "x.mode", F.bround("x.s.meter_score", 6).alias("meter"), (F.coalesce("x.s.rhyme_score", F.lit(0.0)) == 1).alias("rhyme_ok"), F.bround("x.s.total", 6).alias("total"))


@expect(
        "name, ok, score, diff_score, pos_score",
        [("same parts", True, 1.0, 1.0, 1.0), ("other parts", True, 0.666667, 1.0, 0.333333), ("unequal words", True, 1.0, 1.0, None), ("same line", False, 0.5, 0.0, 1.0), ("lengths", False, 0.0, 0.0, None)],
)
def tagged_pairs(spark):
    tags = {"白云": "ns", "黄鹤": "n", "千载": "t", "一去": "v", "悠悠": "z", "不返": "v"}
    rows = [("same parts", "白云白云黄鹤", "黄鹤黄鹤白云"), ("other parts", "白云千载悠悠", "黄鹤一去不返"), ("unequal words", "白云千载", "山水黄鹤"), ("same line", "白云，千载", "白云千载。"), ("lengths", "白云", "黄鹤一")]
    df = spark.createDataFrame(rows, "name string, a string, b string")
    words = spark.createDataFrame([(w, 10, t) for w, t in tags.items()], "word string, freq int, tag string")
    df = with_tags(df.withColumn("text", F.concat_ws("\n", "a", "b")), words)
    pair = scoring.check_parallel(F.col("text"), ((1, 2),), ("pair",), tags=F.col("tags"))["pairs"]["pair"]
    return df.select("name", pair.alias("p")).select("name", "p.ok", F.bround("p.score", 6).alias("score"), F.bround("p.diff_score", 6).alias("diff_score"), F.bround("p.pos_score", 6).alias("pos_score"))


@expect(
        "final, syllable, strict, loose, xinyun",
        [
            ("iang", "liang", "iang", "ang", "10唐"), ("UE", None, "ue", "ue", "ue"), ("i", "shi", "i", "i", "13支"), ("i", "li", "i", "i", "12齐"), ("ü", "qu", "ü", "ü", "12齐"),
            ("uei", "hui", "uei", "uei", "5微"), ("ong", "dong", "ong", "ong", "11庚"), ("u", "wu", "u", "u", "14姑"), (" ao ", "hao", "ao", "ao", "6豪"), (None, None, None, None, None),
        ],
)
def rhyme_groups(spark):
    rows = [("iang", "liang"), ("UE", None), ("i", "shi"), ("i", "li"), ("ü", "qu"), ("uei", "hui"), ("ong", "dong"), ("u", "wu"), (" ao ", "hao"), (None, None)]
    df = spark.createDataFrame(rows, "final string, syllable string")
    own = lambda mode: scoring.normal_final(F.col("final"), mode, F.coalesce("syllable", F.lit(""))).alias(mode)
    return df.select("final", "syllable", own("strict"), own("loose"), own("xinyun"))


@expect("syllable, tone, level", [("lou2", 2, True), ("qu4", 4, False), ("you1", 1, True), ("de", 0, False), ("ma3n", 3, False), ("", 0, False)])
def tone_numbers(spark):
    df = spark.createDataFrame([(s,) for s in ("lou2", "qu4", "you1", "de", "ma3n", "")], "syllable string")
    return df.select("syllable", X.tone_number(F.col("syllable")).alias("tone")).withColumn("level", X.is_level_tone(F.col("tone")))


SCRIPTS = [("朝辭白帝彩雲間", True, False, False), ("朝辭白帝彩雲，", False, False, False), ("𠀀辭白帝彩雲間", True, False, False), ("Я помню чудное", False, True, False), ("ab я", False, True, False)]
SCRIPTS += [("a long line with я", False, False, False), ("이 몸이", False, False, True), ("七個漢字아니다", False, False, True), ("", False, False, False)]


@expect("line, han, russian, hangul", SCRIPTS)
def script_predicates(spark):
    line = F.col("line")
    return spark.createDataFrame([(s[0],) for s in SCRIPTS], "line string").select("line", X.is_exact_han(line).alias("han"), X.is_russian(line).alias("russian"), X.has_hangul(line).alias("hangul"))


CONSTANTS = {"dynasty": "tang", "source": "s", "collection": "c", "source_url": "u", "source_license": "l", "script": "traditional", "form_detection": "structure"}


def _shards(spark: SparkSession) -> DataFrame:
    couplets = [DAWN.split("\n")[0] + "，" + DAWN.split("\n")[1] + "。", DAWN.split("\n")[2] + "，" + DAWN.split("\n")[3] + "。"]
    poem = {"id": "a1", "title": " 早發 ", "author": "李白", "paragraphs": couplets}
    files = [
        ("poet.tang.1000.json", [{**poem, "id": "late"}, "no object", {"title": "no lines"}]),
        ("poet.tang.0.json", [poem, {**poem, "id": None, "author": "  "}, {"id": 7, "title": "short", "author": "x", "paragraphs": couplets[:1]}]),
        ("poet.tang.20.json", [{"id": "h", "title": "登高", "author": "杜甫", "paragraphs": [x + "。" for x in HEIGHT.split("\n")]}, {"id": "bad", "paragraphs": []}]),
        ("poet.tang.9.json", {"not": "an array"}),
    ]
    return spark.createDataFrame([(n, json.dumps(v, ensure_ascii=False)) for n, v in files], "source_file string, value string")


@expect(
        "id, form, n_lines, title, author, source_file, style_is_blank, adaptation, review_status",
        [("tang-a1", "qijue7", 4, "早發", "李白", "poet.tang.0.json", True, None, "unreviewed"), ("tang-h", "qilv7", 8, "登高", "杜甫", "poet.tang.20.json", True, None, "unreviewed")],
)
def shard_records(spark):
    """Shards to annotation records: malformed items left out, forms found, the first of equal texts kept by shard order."""
    items = parse_shards(_shards(spark)).withColumn("lines", X.verse_lines(F.col("paragraphs")))
    found = forms.with_form(items).withColumn("text", F.array_join("lines", "\n"))
    first = forms.keep_first(found, ["text"], ["shard_no", "source_file", "item_pos"])
    records = forms.to_records(first.withColumn("author", X.author_of(F.col("author"))), CONSTANTS)
    blank = (F.size("style.emotion") == 0) & (F.size("style.imagery") == 0) & (F.concat("style.diction", "style.expression", "style.energy", "style.density") == "")
    return records.select(
        "id", "form", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "metadata.title", "metadata.author", "metadata.source_file", blank.alias("style_is_blank"),
        "culture.adaptation", "metadata.review_status",
    )


@expect("source_file, shard_no, n", [("poet.tang.0.json", 0, 3), ("poet.tang.20.json", 20, 1)])
def first_shards(spark):
    """The first three shards by number; one of them is no array."""
    return parse_shards(_shards(spark), 3).groupBy("source_file", "shard_no").agg(F.count("*").alias("n"))


TAXONOMY = {"emotion": ["melancholic", "lonely", "joyful"], "diction": ["refined", "plain"], "expression": ["balanced"], "energy": ["gentle"]}
POEM = "秋月照江舟\n孤雁過寒洲\n客路連山遠\n霜風入古樓"


def _answer(**changes) -> str:
    full = {"emotion": {"value": ["melancholic", "lonely"], "confidence": 0.88, "evidence": ["孤雁", "客路"]}, "diction": {"value": "refined", "confidence": 0.77, "evidence": ["秋月"]}}
    full |= {"expression": {"value": "balanced", "confidence": 0.81, "evidence": []}, "energy": {"value": "gentle", "confidence": 0.7004, "evidence": ["照江舟孤雁"]}}
    for k, v in changes.items():
        full[k] = {n: x for n, x in (full[k] | v).items() if x is not None} if isinstance(v, dict) else v
    return json.dumps(full, ensure_ascii=False)


ANSWERS = [
    ("good", _answer(), None, True), ("fenced", "```json\n" + _answer() + "\n```", None, True), ("talk around it", "Here: " + _answer() + " done", None, True), ("no evidence key", _answer(energy={"evidence": None}), None, True),
    ("hallucinated", _answer(emotion={"evidence": ["萬里悲秋"]}), "emotion: evidence not found in the text", False), ("three labels", _answer(emotion={"value": ["melancholic", "lonely", "joyful"]}), "emotion: label not allowed", False),
    ("no labels", _answer(emotion={"value": []}), "emotion: label not allowed", False), ("twice", _answer(emotion={"value": ["lonely", "lonely"]}), "emotion: label not allowed", False), ("unknown", _answer(diction={"value": "loud"}), "diction: label not allowed", False),
    ("boolean", _answer(energy={"confidence": True}), "energy: bad confidence", False), ("beyond one", _answer(energy={"confidence": 1.01}), "energy: bad confidence", False), ("four proofs", _answer(energy={"evidence": ["秋", "月", "江", "舟"]}), "energy: bad evidence", False),
    ("no block", _answer(expression=[]), "expression: no object", False), ("no json", "sorry", "no object", False), ("null", None, "no object", False),
]


@expect("name, error, complete, energy, confidence", [(n, e, c, "gentle" if c else None, 0.7 if c else None) for n, _, e, c in ANSWERS])
def answer_validation(spark):
    """A model's answers against the taxonomy, taken into pending labels where they hold."""
    rows = spark.createDataFrame([(n, a) for n, a, _, _ in ANSWERS], "name string, answer string").withColumn("text", F.lit(POEM))
    pending = rows.withColumn("prelabel", F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS]))
    merged = annotate.apply_answers(pending, "answer", TAXONOMY)
    return merged.select("name", F.get("errors.message", F.lit(0)).alias("error"), annotate.is_complete(F.col("prelabel")).alias("complete"), F.col("prelabel.energy.value").alias("energy"), F.col("prelabel.energy.confidence").alias("confidence"))


@expect("attempted, succeeded, failed, left, stopped", [(15, 4, 11, 0, False)])
def run_counters(spark):
    rows = answer_validation(spark)
    return annotate.run_counts(rows, F.col("error").isNull(), F.col("error").isNotNull(), 15)


def _sample_rows(spark: SparkSession) -> DataFrame:
    rows = [(f"{f}-{a}-{k}", f, a) for f, authors in (("qijue7", "ABCD"), ("qilv7", "ABEF")) for a in authors for k in range(1, 4)]
    return spark.createDataFrame(rows, "id string, form string, author string")


DRAWN = ["qilv7-E-3", "qilv7-A-2", "qijue7-D-1", "qijue7-C-1", "qijue7-C-3", "qilv7-B-2", "qijue7-B-2", "qijue7-A-2", "qilv7-F-1", "qilv7-F-2", "qijue7-A-1"]
TARGETS, SEED = {"qijue7": 6, "qilv7": 5}, 20260823


@expect("annotation_pos, id", [(i, x) for i, x in enumerate(DRAWN, 1)])
def two_form_sample(spark):
    """What a sequential program draws, with a stream for each form."""
    drawn = sampling.exact_sample(_sample_rows(spark), "form", "author", "id", TARGETS, SEED, 2, {"qijue7": 101, "qilv7": 211})
    return drawn.select("annotation_pos", "id")


@expect("form, n, target, seed, most, review_status, annotation_method, sample_version", [(f, n, n, SEED, 2, "pending_annotation", "unlabeled", "v1") for f, n in TARGETS.items()],
)
def sample_metadata(spark):
    records = two_form_sample(spark).join(_sample_rows(spark), "id")
    records = records.withColumn("metadata", F.struct("author", F.lit("style_unlabeled").alias("annotation_method"), F.lit("unreviewed").alias("review_status")))
    m = sampling.tag_sample(records, SEED, TARGETS, 2).select("form", "metadata.*").select("form", "annotation_method", "review_status", "sampling.*")
    group = ("form", F.col("form_target").alias("target"), "seed", F.col("max_per_author_per_form").alias("most"), "review_status", "annotation_method", "sample_version")
    return m.groupBy(*group).agg(F.count("*").alias("n"))


KOREAN = [
    "译文：开头", "乡歌：", "形式：说明", "译文：先有译文", "接着", "译文没有冒号", "薯童谣서동요（四句体）", "“吏读”版本：善化", "公主主隐", "现代韩文版：처음", "现代韩文版：선화 / 공주", "中文翻译：善化公主 / 一",
    "时调：", "原文：이 몸이 / 죽어 （郑梦周 作）", "译文：此身", "死了。", "辞说时调：", "原文：창 내고자", "译文：开窗。", "山有花", "原文：산에는", "꽃 피네", "译文：山有花", "没有标点的题", "原文：", "译文：",
]


@expect(
        "id, form, title_zh, title_ko, title, author, hyangchal, text_ko, text_zh",
        [
            ("ko-misc-001", None, None, None, None, None, None, None, "开头"),
            ("ko-hyangga-002", None, None, None, None, None, None, None, "先有译文\n接着\n译文没有冒号"),
            ("ko-hyangga-003", "四句体", "薯童谣", "서동요", None, None, "善化\n公主主隐", "선화\n공주", "善化公主 / 一"),
            ("ko-sijo-004", None, None, None, None, "郑梦周", None, "이 몸이\n죽어", "此身\n死了。"),
            ("ko-sijo-variant-005", None, None, None, None, None, None, "창 내고자", "开窗。\n山有花"),
            ("ko-modern-006", None, None, None, "山有花", None, None, "산에는\n꽃 피네", "山有花\n没有标点的题"),
        ],
)
def korean_entries(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(KOREAN)], "doc string, pos int, line string")
    return segment.parse_documents(lines, "ko", source="s").drop("section", "lang", "source")


RUSSIAN = ["前言", "致大海①", "再见吧", "1824", "戈宝权译", "①注", "Прощай, свободная стихия", "注二", "我记得那美妙的一瞬", "俄语原文：", "Я помню", "1825", "中译文：", "我记得"]


@expect(
        "id, title_zh, year, translator, text_ru, text_zh, notes",
        [("ru-pushkin-001", "致大海①", "1824", "戈宝权", "Прощай, свободная стихия", "再见吧", "①注\n注二"), ("ru-pushkin-002", "我记得那美妙的一瞬", None, None, "Я помню", "我记得", "1825")],
)
def russian_entries(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(RUSSIAN)], "doc string, pos int, line string")
    return segment.parse_documents(lines, "ru", source="s").drop("author", "lang", "source")


@expect("id, entry", [("ko-misc-001", "b"), ("ko-misc-002", "a"), ("ko-misc-003", "c")])
def numbered_entries(spark):
    return segment.number_entries(spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "entry string, pos int"), ["pos"], "ko-misc").select("id", "entry")


IMAGERY = [("celestial", 0, "銀河"), ("celestial", 0, "月"), ("landscape", 1, "河"), ("landscape", 1, "山"), ("travel", 2, "關"), ("frontier", 3, "關"), ("flora", 4, "花"), ("fauna", 5, "鳥")]


@expect(
        "id, category, terms",
        [(1, "celestial", "銀河"), (2, "celestial", "月,銀河"), (2, "travel", "關"), (2, "frontier", "關"), (2, "landscape", "山")]
        + [(i, c, "") for i, cs in ((1, ("landscape", "travel", "frontier", "flora", "fauna")), (2, ("flora", "fauna")), (3, ("celestial", "landscape", "travel", "frontier", "flora", "fauna"))) for c in cs],
)
def longest_terms(spark):
    """Terms by first occurrence, over line ends; 河 stands inside 銀河; categories without hits have no terms."""
    docs = spark.createDataFrame([(1, "銀\n河落九天"), (2, "關山月銀河月"), (3, None)], "id int, text string")
    words = spark.createDataFrame(IMAGERY, "category string, cat_pos int, term string")
    terms = lexicon.category_terms(lexicon.find_matches(docs, words))
    return lexicon.all_categories(docs, terms, words).select("id", "category", F.array_join("terms", ",").alias("terms"))


@expect(
        "url, ascii",
        [("http://h/a b/é.json", "http://h/a%20b/%C3%A9.json"), ("http://h/全唐诗?ref=主", "http://h/%E5%85%A8%E5%94%90%E8%AF%97?ref=%E4%B8%BB"), ("http://h/%E5%85%A8", "http://h/%E5%85%A8")],
)
def encoded_urls(spark):
    df = spark.createDataFrame([("http://h/a b/é.json",), ("http://h/全唐诗?ref=主",), ("http://h/%E5%85%A8",)], "url string")
    return df.select("url", X.ascii_url(F.col("url")).alias("ascii"))


@expect("id, reason", [("b", "missing style"), ("c", "unknown form cifu"), ("d", "missing text,form")])
def record_checks(spark):
    rows = [("a", "t", "qijue7", "s"), ("b", "t", "qijue7", None), ("c", "t", "cifu", "s"), ("d", None, None, "s")]
    df = spark.createDataFrame(rows, "id string, text string, form string, style string")
    return forms.record_violations(df, ["qijue7", "qilv7"], "id", ("id", "text", "form", "style"))


STYLE_ROWS = [(c, lang) for c in [*prompts.STYLES, "none"] for lang in ("ZH", "KO", "RU")]


OFFERED = {"KO": "sijo,gasa,modern", "RU": "sonnet,ode,lyric,modern", "ZH": "jueju,lvshi,ci,qu,modern"}


@expect("code, lang, style, offered", [(c, lang, prompts.STYLES.get(c, prompts.DEFAULT_STYLE), OFFERED[lang]) for c, lang in STYLE_ROWS])
def style_tables(spark):
    df = spark.createDataFrame(STYLE_ROWS, "code string, lang string")
    return df.select("code", "lang", prompts.style_name(F.col("code")).alias("style"), F.array_join(prompts.offered_styles(F.col("lang")), ",").alias("offered"))
