"""Entries from paragraphs: headers, markers and lines that go on, by windows; and two paragraph grammars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quatrain.functions import text as X
from quatrain.operators.ordering import number_rows


def number_paragraphs(docs: DataFrame, doc: str, text_col: str) -> DataFrame:
    """(doc, pos, line) of stripped paragraphs that are not blank."""
    return docs.select(doc, F.posexplode(X.raw_lines(F.col(text_col))).alias("pos", "line"))


def sessionize(lines: DataFrame, doc: str, starts, markers: Sequence[tuple[str, str]], skip=None) -> DataFrame:
    """Entries of each document. starts: condition of a line that begins one; markers: (field, prefix) of lines that begin
    a field, whose rest is its first line. Lines go on with the field before them. Gives (doc, entry, title, field, text,
    before), where before is the line ahead of the entry. One shuffle, by document."""
    w = Window.partitionBy(doc).orderBy("pos")
    kept = lines if skip is None else lines.where(~skip)
    field = F.coalesce(*[F.when(F.startswith("line", F.lit(p)), F.lit(f)) for f, p in markers])
    rest = F.coalesce(*[F.when(F.startswith("line", F.lit(p)), F.substring("line", F.lit(len(p) + 1), F.length("line"))) for f, p in markers], F.when(starts, F.lit("")), F.col("line"))
    marked = kept.select(doc, "pos", "line", starts.alias("begins"), field.alias("own"), rest.alias("rest"), F.lag("line").over(w).alias("ahead"))
    numbered = marked.withColumn("entry", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_entry = Window.partitionBy(doc, "entry").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fielded = numbered.where("entry > 0").withColumn("field", F.last("own", ignorenulls=True).over(in_entry)).withColumn("title", F.first("line").over(in_entry)).withColumn("before", F.first("ahead").over(in_entry))
    listed = fielded.where("field is not null and rest <> ''").groupBy(doc, "entry", "title", "before", "field").agg(F.sort_array(F.collect_list(F.struct("pos", "rest"))).alias("x"))
    return listed.select(doc, "entry", "title", "field", F.array_join(F.transform("x", lambda s: s["rest"]), "\n").alias("text"), "before")


def number_entries(entries: DataFrame, order: Sequence[str], prefix: str) -> DataFrame:
    """Ids with a running number over all entries, three digits or more. Entries are numbered in ranges of the order, none
    of them in one task; entries that tie in the order come in any."""
    numbered = number_rows(entries, order, "__number")
    return numbered.withColumn("id", F.concat(F.lit(f"{prefix}-"), _three_digits(F.col("__number")))).drop("__number")


def _three_digits(n):
    text = n.cast("string")
    return F.when(n < 1000, F.lpad(text, 3, "0")).otherwise(text)


def incomplete_pairs(df: DataFrame, id_col: str, originals: Sequence[str], translation: str) -> DataFrame:
    """Rows with neither original, or without the translation."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    none = F.lit(True)
    for c in originals:
        none = none & empty(c)
    return df.where(none | empty(translation)).select(id_col, none.alias("no_original"), empty(translation).alias("no_translation"))


#: Fixed values of the two paragraph grammars.
KO_OLDEST, KO_VARIANT, KO_MODERN = "乡歌", "辞说时调", "现代诗"
KO_SECTIONS = {"乡歌": "hyangga", "时调": "sijo", "辞说时调": "sijo-variant", "现代诗": "modern"}
KO_PROSE = ("形式：", "四句体：", "十句体：", "吏读：", "平时调：", "两种变体：")
KO_TITLE = r"^(.*?)([가-힣][가-힣\s]*)?（(四句体|八句体|十句体)）\z"
KO_AUTHOR = r"[（(]([^（）()]{1,12})\s*作[）)]"
KO_FIELDS = (("hyangchal", "“吏读”版本："), ("text_ko", "现代韩文版："), ("text_zh", "中文翻译："))
SENTENCE_ENDS = ("：", "。", "！", "？", "；", "，", "…")
RU_TITLES = ("给娜塔利亚", "我记得那美妙的一瞬", "致大海")
RU_AUTHOR = "普希金"
RU_MARKS = (("text_ru", "俄语原文："), ("text_zh", "中译文："))
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"

KO_SCHEMA = "id string, section string, form string, title_zh string, title_ko string, title string, author string, lang string, source string, hyangchal string, text_ko string, text_zh string"
RU_SCHEMA = "id string, author string, title_zh string, year string, translator string, lang string, source string, text_ru string, text_zh string, notes string"


def _upto(doc: str, *more: str):
    """Rows of a document (and group) up to the current one."""
    return Window.partitionBy(doc, *more).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _joined(condition, text):
    """The texts of a group's rows that meet the condition, in order, one a line; null if there are none."""
    rows = F.sort_array(F.collect_list(F.when(condition, F.struct("pos", text.alias("t")))))
    return F.when(F.size(rows) > 0, X.strip(F.array_join(F.transform(rows, lambda r: r["t"]), "\n")))


def korean_entries(lines: DataFrame, doc: str = "doc", source: str = "") -> DataFrame:
    """Entries of (doc, pos, line) by section headers, titles and field marks. Lines are classified alone; sections, entries
    and fields are then running values over the document, so one shuffle by document does.

    In the oldest section an entry begins with a title and has three marked fields; elsewhere it begins with its original
    or, where none is open, with its translation. A line ahead of an original is its heading unless it is marked itself or
    ends like a sentence, and the first heading among sijo variants turns that section to modern poems. Lines without a
    mark go on with the field before them; a field that is marked again in an entry starts anew."""
    everything = Window.partitionBy(doc).orderBy("pos")
    line = F.col("line")
    begins = lambda marks: line.rlike(f"^(?:{'|'.join(marks)})")
    header = line.isin([f"{s}：" for s in KO_SECTIONS if s != KO_MODERN])
    ahead = F.lag("line").over(everything)
    no_heading = ahead.rlike(f"^(?:译文|原文|{'|'.join(KO_PROSE)})") | ahead.rlike(f"[{''.join(SENTENCE_ENDS)}]\\z")
    known = lines.select(doc, "pos", "line").select(
        "*",
        F.when(header, F.expr("substring(line, 1, length(line) - 1)")).alias("named"),
        (~header & begins(KO_PROSE)).alias("prose"),
        F.when(~no_heading, ahead).alias("heading"),
    )
    known = known.withColumn("chapter", F.last("named", ignorenulls=True).over(_upto(doc))).withColumn("old", F.coalesce(F.col("chapter") == KO_OLDEST, F.lit(False)))
    known = known.where(~F.col("prose"))
    title = F.col("old") & F.col("named").isNull() & line.rlike(KO_TITLE)
    original = F.col("named").isNull() & ~title & line.startswith("原文：")
    # a boundary closes what is open; a translation opens an entry only where none is
    marked = known.withColumn("boundary", F.when(F.col("named").isNotNull(), "header").when(title, "title").when(original, "original"))
    marked = marked.withColumn("part", F.count("boundary").over(_upto(doc))).withColumn("within", F.first("boundary").over(_upto(doc, "part")))
    unopened = F.coalesce(F.col("within") == "header", F.lit(True))
    late = F.when(unopened & line.startswith("译文："), F.lit(1))
    marked = marked.withColumn("opened", F.count(late).over(_upto(doc, "part")))
    in_entry = ~unopened | (F.col("opened") > 0)
    field = F.when(original, "text_ko").when(
        F.col("old") & in_entry & F.col("boundary").isNull(), F.coalesce(*[F.when(line.startswith(m), f) for f, m in KO_FIELDS])
    )
    field = F.coalesce(field, F.when(F.col("boundary").isNull() & line.startswith("译文："), F.lit("text_zh")))
    turned = F.max(F.col("heading").isNotNull() & (F.col("boundary") == "original")).over(_upto(doc, "chapter_no"))
    marked = marked.where(in_entry | F.col("named").isNotNull()).withColumn("chapter_no", F.count("named").over(_upto(doc)))
    fielded = marked.select(
        "*",
        field.alias("own"),
        F.when((F.col("chapter") == KO_VARIANT) & F.coalesce(turned, F.lit(False)), KO_MODERN).otherwise(F.col("chapter")).alias("section"),
    ).where("named is null")
    fielded = fielded.withColumn("run", F.count("own").over(_upto(doc, "part"))).withColumn("field", F.last("own", ignorenulls=True).over(_upto(doc, "part")))
    # of a field that is marked more than once in an entry the last run counts
    fielded = fielded.withColumn("last_run", F.max("run").over(Window.partitionBy(doc, "part", "field")))
    # a mark without its colon goes on with a translation, but not with the first field
    stray = F.col("old") & (F.col("field") == "hyangchal") & line.rlike("^(?:译文|原文)") & F.col("own").isNull()
    rest = F.when(F.col("own").isNotNull(), F.expr("substring(line, instr(line, '：') + 1)")).otherwise(line)
    held = (F.col("run") == F.col("last_run")) & ~stray & ~(F.col("own").isNotNull() & (rest == "")) & (F.coalesce(F.col("boundary"), F.lit("")) != "title")
    first = lambda c: F.min_by(c, "pos")
    group = lambda k: F.regexp_extract("title_line", KO_TITLE, k)
    entries = fielded.groupBy(doc, "part").agg(
        F.min("pos").alias("pos"),
        first("section").alias("section"),
        first("boundary").alias("boundary"),
        first("line").alias("title_line"),
        first("heading").alias("heading"),
        *[_joined(held & (F.col("field") == f), rest).alias(f) for f, _ in KO_FIELDS],
    )
    entries = entries.where(" or ".join(f"coalesce({f}, '') <> ''" for f, _ in KO_FIELDS))
    titled = F.col("boundary") == "title"
    filled = lambda c: F.when(titled & (X.strip(c) != ""), X.strip(c))
    # one line with slashes is several; the author is looked for in it as it was
    one_line = F.col("text_ko").contains(" / ") & ~F.col("text_ko").contains("\n")
    author = F.regexp_extract("text_ko", KO_AUTHOR, 1)
    shown = F.when(one_line, F.regexp_replace("text_ko", r"(?U)\s*/\s*", "\n")).otherwise(F.col("text_ko"))
    section = F.coalesce(*[F.when(F.col("section") == s, F.lit(code)) for s, code in KO_SECTIONS.items()], F.lit("misc"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("pos"))
    out = entries.select(
        F.concat(F.lit("ko-"), section, F.lit("-"), _three_digits(number)).alias("id"), section.alias("section"),
        F.when(titled, group(3)).alias("form"), filled(group(1)).alias("title_zh"), filled(group(2)).alias("title_ko"),
        F.when(F.col("boundary") == "original", F.col("heading")).alias("title"),
        F.when(author != "", X.strip(author)).alias("author"), F.lit("ko").alias("lang"), F.lit(source).alias("source"),
        "hyangchal", F.when(author != "", X.strip(F.regexp_replace(shown, KO_AUTHOR, ""))).otherwise(shown).alias("text_ko"), "text_zh",
    )
    return out.select(*[f.split()[0] for f in KO_SCHEMA.split(", ")])


def russian_entries(lines: DataFrame, doc: str = "doc", source: str = "", author: str = RU_AUTHOR, titles: Sequence[str] = RU_TITLES) -> DataFrame:
    """Entries of (doc, pos, line) that begin with one of the titles.

    Titles and marks cut a document into runs. A run that begins with a title or the mark of the translation is Chinese,
    with years and translators on lines of their own, until a line in Cyrillic or one that begins with a circled number;
    from there, and in all other runs, Cyrillic lines are the original and all others are notes."""
    line = F.col("line")
    title = line.rlike(f"^(?:{'|'.join(titles)})[\\s{CIRCLED}]*\\z")
    mark = F.coalesce(*[F.when(line == m, F.lit(f)) for f, m in RU_MARKS])
    kinds = lines.select(doc, "pos", "line", title.alias("title"), mark.alias("mark"), X.is_russian(line).alias("russian"), line.rlike(f"^[{CIRCLED}]").alias("circled"))
    kinds = kinds.withColumn("entry", F.sum(F.col("title").cast("int")).over(_upto(doc))).where("entry > 0")
    runs = kinds.withColumn("run", F.count(F.when(F.col("title") | F.col("mark").isNotNull(), 1)).over(_upto(doc)))
    runs = runs.withColumn("chinese", F.first(F.col("title") | (F.col("mark") == "text_zh")).over(_upto(doc, "run")))
    year, translator = line.rlike(r"^\d{4}\z"), line.endswith("译")
    leaves = F.col("circled") | F.col("russian") & ~year & ~translator
    before = _upto(doc, "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("leaves", leaves & ~F.col("title") & F.col("mark").isNull())
    runs = runs.withColumn("in_chinese", F.col("chinese") & ~F.coalesce(F.max("leaves").over(before), F.lit(False)))
    field = (
        F.when(F.col("title") | F.col("mark").isNotNull(), None)
        .when(F.col("in_chinese") & F.col("circled"), "notes")
        .when(F.col("in_chinese") & year, "year")
        .when(F.col("in_chinese") & translator, "translator")
        .when(F.col("russian"), "text_ru")
        .when(F.col("in_chinese"), "text_zh")
        .otherwise("notes")
    )
    fielded = runs.withColumn("field", field)
    last = lambda f: F.max_by(F.when(F.col("field") == f, line), F.when(F.col("field") == f, F.col("pos")))
    marked = lambda f: F.when(F.max(F.col("mark") == f), F.lit(""))
    entries = fielded.groupBy(doc, "entry").agg(
        F.min_by("line", "pos").alias("head"), last("year").alias("year"), last("translator").alias("named"),
        *[F.coalesce(_joined(F.col("field") == f, line), marked(f)).alias(f) for f in ("text_ru", "text_zh")],
        _joined(F.col("field") == "notes", line).alias("notes"),
    )
    out = entries.select(
        F.concat(F.lit("ru-pushkin-"), _three_digits(F.col("entry"))).alias("id"), F.lit(author).alias("author"), X.strip(F.col("head")).alias("title_zh"), "year",
        X.strip(F.expr("substring(named, 1, length(named) - 1)")).alias("translator"), F.lit("ru").alias("lang"), F.lit(source).alias("source"), "text_ru", "text_zh", "notes",
    )
    return out.select(*[f.split()[0] for f in RU_SCHEMA.split(", ")])


def parse_documents(paragraphs: DataFrame, grammar: str, doc: str = "doc", source: str = "") -> DataFrame:
    """(doc, pos, line) to entries by grammar ko or ru; entries are numbered within their document."""
    return korean_entries(paragraphs, doc, source) if grammar == "ko" else russian_entries(paragraphs, doc, source)
