from __future__ import annotations

import random
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quatrain import sources
from quatrain.functions import text as X
from quatrain.operators import annotate, forms, lexicon, prompts, sampling, segment
from quatrain.streaming import distinct_stream, read_jsonl_stream, window_counts

POEM = ["朝辭白帝彩雲間，千里江陵一日還。", "兩岸猿聲啼不住，輕舟已過萬重山。"]
CONSTANTS = dict.fromkeys(["dynasty", "source", "collection", "source_url", "source_license", "script", "form_detection"], "x")


def shards(folder):
    items = [
        {"id": "a1", "title": " t ", "author": "李白", "paragraphs": POEM},
        {"id": "a2", "title": "t", "author": "", "paragraphs": [p.replace("，", "。") for p in POEM]},
        {"id": 0, "author": None, "paragraphs": [*POEM, POEM[0]]},
        "no object", {"paragraphs": []}, {"paragraphs": "x"}, {"id": "n", "paragraphs": [3, "一二三"]},
    ]
    (folder / "poet.tang.1000.json").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    (folder / "poet.tang.0.json").write_text(json.dumps({"no": "array"}), encoding="utf-8")
    (folder / "poet.tang.200.json").write_text(json.dumps([{"paragraphs": POEM}], ensure_ascii=False), encoding="utf-8")
    (folder / "other.json").write_text("[]", encoding="utf-8")


def test_shards_to_records(spark, tmp_path):
    shards(tmp_path)
    items = sources.read_json_shards(spark, str(tmp_path)).withColumn("lines", X.verse_lines(F.col("paragraphs")))
    assert items.count() == 5
    found = forms.with_form(items).withColumn("text", F.array_join("lines", "\n"))
    assert found.count() == 3
    first = forms.keep_first(found, ["text"], ["shard_no", "source_file", "item_pos"])
    row = forms.to_records(first, CONSTANTS).first()
    assert first.count() == 1 and row["form"] == "qijue7" and row["id"].startswith("tang-sha1-") and row["metadata"]["source_file"] == "poet.tang.200.json"
    assert row["style"].asDict() == {"emotion": [], "imagery": [], "diction": "", "expression": "", "energy": "", "density": ""} and row["culture"]["adaptation"] is None
    assert sources.read_json_shards(spark, str(tmp_path), max_files=1).count() == 0
    assert forms.limited(items, ["shard_no", "item_pos"], 0).count() == 1
    with pytest.raises(Exception):
        sources.read_json_shards(spark, str(tmp_path / "none")).count()


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    sources.write_jsonl(df, str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert sorted(map(tuple, sources.read_jsonl(spark, str(tmp_path / "out"), "a int, b string").collect())) == [(1, None), (2, "é")]
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\n[1]\n')
    with pytest.raises(ValueError, match=r"\[1\]"):
        sources.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")
    stream = distinct_stream(read_jsonl_stream(spark, str(tmp_path / "out"), "a int, b string"), ["b"])
    query = stream.writeStream.format("memory").queryName("rows").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rows").count() == 2


def test_names_and_taxonomies():
    assert sources.asked_names(" qilv7, qijue7,qilv7", ("qijue7", "qilv7")) == ["qilv7", "qijue7"]
    for bad in ("", " , ", "cifu"):
        with pytest.raises(ValueError):
            sources.asked_names(bad, ("qijue7",))
    config = {"style": {"emotion": {"values": {"joy": "喜"}}, "energy": {"values": []}}}
    assert sources.taxonomy_of(config, ("emotion",)) == {"emotion": ["joy"]}
    for d in ("energy", "none"):
        with pytest.raises(ValueError, match=d):
            sources.taxonomy_of(config, (d,))


def test_docx_and_fingerprint(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("乡歌：", "  ", "原文：가나", "译文：一"))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    assert [r["line"] for r in sources.read_docx(spark, str(tmp_path / "a.docx")).orderBy("pos").collect()] == ["乡歌：", "原文：가나", "译文：一"]
    assert len(sources.fingerprints(spark, str(tmp_path / "a.docx")).first()["sha256"]) == 64


def sample_rows(spark):
    rows = [(f"{f}-{a}-{i}", f, a) for f, names in (("qijue7", "ABCD"), ("qilv7", "ABEF")) for a in names for i in range(3)]
    return spark.createDataFrame(rows, "id string, form string, author string")


def test_sampling(spark):
    df = sample_rows(spark)
    four = sampling.balanced_sample(df, "form", "author", "id", {"qijue7": 4}, 5).collect()
    assert len({r["author"] for r in four}) == 4
    with pytest.raises(ValueError, match="capacity"):
        sampling.balanced_sample(df, "form", "author", "id", {"qijue7": 5}, 5)
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, "form", "author", "id", {"qijue7": -1}, 5)
    draw = lambda seed: [(r["annotation_pos"], r["id"]) for r in sampling.balanced_sample(df, "form", "author", "id", {"qijue7": 6, "qilv7": 3, "x": 0}, seed, 2).orderBy("annotation_pos").collect()]
    got = draw(1)
    assert got == draw(1) != draw(2) and [p for p, _ in got] == list(range(1, 10)) and len({i for _, i in got}) == 9
    per = {}
    for _, i in got:
        per[i[:-2]] = per.get(i[:-2], 0) + 1
    assert max(per.values()) == 2 and sum(n for k, n in per.items() if k.startswith("qijue7")) == 6
    with pytest.raises(Exception, match="capacity"):
        sampling.exact_sample(df, "form", "author", "id", {"qilv7": 50}, 3, 2).collect()
    assert sampling.exact_sample(df, "form", "author", "id", {"qilv7": 0}, 3, 2).count() == 0
    row = annotate.diversity(df).first()
    assert tuple(row) == (6, 2, 6)
    assert annotate.diversity(df.limit(0)).first()["most_rows"] == 0


LEXICON = [("celestial", 0, "銀河"), ("celestial", 0, "月"), ("landscape", 1, "河"), ("landscape", 1, "山"), ("travel", 2, "關"), ("frontier", 3, "關"), ("flora", 4, "花"), ("fauna", 5, "鳥")]


def labels(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    lex = spark.createDataFrame(LEXICON, "category string, cat_pos int, term string")
    terms = lexicon.category_terms(lexicon.find_matches(docs, lex))
    return docs, terms, lexicon.imagery_prelabel(docs, terms).join(lexicon.density_prelabel(docs, terms), "id")


def test_longest_match_and_labels(spark):
    _, terms, found = labels(spark, ["銀\n河落九天", "無", "", "關山月花鳥鳥", None])
    by_id = {r["id"]: r for r in found.collect()}
    assert {(r["category"], tuple(r["terms"])) for r in terms.where("id = '0'").collect()} == {("celestial", ("銀河",))}
    assert by_id["1"]["imagery"]["confidence"] == 0.2 and by_id["1"]["imagery"]["value"] == [] and by_id["1"]["density"]["value"] == "sparse"
    top = by_id["3"]["imagery"]
    assert top["value"] == ["celestial", "landscape", "travel", "frontier"] and top["confidence"] == pytest.approx(0.86) and top["evidence"]["travel"] == ["關"]
    dense = by_id["3"]["density"]
    assert dense["value"] == "dense" and dense["evidence"]["unique_imagery_terms"] == 5 and dense["confidence"] == 0.85
    assert dense["evidence"]["selected_imagery_labels"] == top["value"] and dense["evidence"]["scope_note"] == lexicon.DENSITY_SCOPE
    assert by_id["2"]["density"]["evidence"]["line_count"] == 0


def test_matches_by_definition(spark):
    rnd = random.Random(6)
    terms = sorted({"".join(rnd.choice("abc月") for _ in range(rnd.randint(1, 9))) for _ in range(60)} | {"a.c", "\\Q", "𠀀a"})
    lex = spark.createDataFrame([(f"c{i % 5}", i % 5, t) for i, t in enumerate(terms)] + [("more", 9, terms[0])], "category string, cat_pos int, term string")
    texts = ["".join(rnd.choice("abc月\n.Q\\𠀀") for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", terms[0], terms[0]]
    docs = spark.createDataFrame([(i % 70, t) for i, t in enumerate(texts)], "id int, text string")
    cat = {}
    for i, t in enumerate(terms):
        cat.setdefault(t, []).append(f"c{i % 5}")
    cat[terms[0]].append("more")
    want = []
    for i, text in enumerate(texts):
        flat = (text or "").replace("\n", "")
        hits = {(s, s + len(t), t) for t in terms for s in range(len(flat)) if flat.startswith(t, s)}
        kept = [h for h in hits if not any(o[0] <= h[0] and h[1] <= o[1] and o[1] - o[0] > h[1] - h[0] for o in hits)]
        want += [(i % 70, c, t, s, e) for s, e, t in kept for c in cat[t]]
    for signs in (1_000_000, 60):
        got = [tuple(r) for r in lexicon.find_matches(docs, lex, block_signs=signs).drop("cat_pos").collect()]
        assert sorted(got) == sorted(want)
    assert lexicon.find_matches(docs, lex.limit(0)).count() == 0


def test_every_category(spark):
    docs, terms, _ = labels(spark, ["銀河", "無"])
    lex = spark.createDataFrame(LEXICON, "category string, cat_pos int, term string")
    rows = lexicon.all_categories(docs, terms, lex).collect()
    assert len(rows) == 12 and {(r["id"], r["category"]): r["terms"] for r in rows if r["terms"]} == {("0", "celestial"): ["銀河"]}


def test_covered_matches_by_definition(spark):
    import random

    rnd = random.Random(2)
    rows = [(d, "c", 0, "t", s := rnd.randint(0, 30), s + rnd.randint(1, 8)) for d in range(6) for _ in range(30)]
    df = spark.createDataFrame(rows, "id int, category string, cat_pos int, term string, start int, end int")
    got = sorted(map(tuple, lexicon.suppress_covered(df).collect()))
    want = [r for r in rows if not any(o[0] == r[0] and o[5] - o[4] > r[5] - r[4] and o[4] <= r[4] and o[5] >= r[5] for o in rows)]
    assert got == sorted(want)


TAXONOMY = {"emotion": ["joy", "grief", "longing"], "diction": ["plain", "ornate"], "expression": ["direct"], "energy": ["still"]}


def answer(**changes):
    part = {"confidence": 0.5, "evidence": ["白帝"]}
    full = {"emotion": {"value": ["joy"], **part}, "diction": {"value": "plain", **part}, "expression": {"value": "direct", **part}, "energy": {"value": "still", **part}}
    for k, v in changes.items():
        full[k] = v if not isinstance(v, dict) else {**full[k], **v}
    return json.dumps(full, ensure_ascii=False)


CASES = [
    (answer(), None), ("```json\n" + answer() + "\n```", None), ("no", "no object"), (answer(emotion={"value": ["joy", "grief", "longing"]}), "emotion: label not allowed"),
    (answer(emotion={"value": ["joy", "joy"]}), "emotion: label not allowed"), (answer(diction={"value": "loud"}), "diction: label not allowed"), (answer(energy={"confidence": True}), "energy: bad confidence"),
    (answer(energy={"confidence": 1.5}), "energy: bad confidence"), (answer(energy={"evidence": ["長安"]}), "energy: evidence not found in the text"), (answer(energy={"evidence": []}), None),
    (answer(energy={"evidence": ["a", "b", "c", "d"]}), "energy: bad evidence"), (answer(expression=[]), "expression: no object"), (answer(energy={"evidence": ["間千里"]}), None),
]


def test_answers(spark):
    docs = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "id int, answer string").withColumn("text", F.lit("朝辭白帝彩雲間\n千里江陵一日還"))
    pending = docs.withColumn("prelabel", F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS]))
    rows = annotate.apply_answers(pending, "answer", TAXONOMY).withColumn("done", annotate.is_complete(F.col("prelabel"))).orderBy("id").collect()
    for r, (_, error) in zip(rows, CASES):
        assert ([e["message"] for e in r["errors"]] or [None])[0] == error and r["done"] == (error is None), r["id"]
    assert rows[0]["prelabel"]["emotion"]["value"] == ["joy"] and rows[0]["prelabel"]["energy"]["confidence"] == 0.5

    def client(prompt):
        if "boom" in prompt:
            raise RuntimeError("boom")
        return prompt.upper()

    asked = annotate.ask_model(spark.createDataFrame([("a",), ("boom",)], "p string"), "p", client).collect()
    assert [(r["answer"], r["failure"]) for r in asked] == [("A", None), (None, "boom")]


def test_errors_of_earlier_runs_stay(spark):
    docs, _, found = labels(spark, ["朝辭白帝彩雲間\n關山月", "花"])
    records = docs.withColumn("metadata", F.struct(F.lit("x").alias("author"), F.lit("a").alias("annotation_method"), F.lit("b").alias("review_status")))
    first = annotate.with_rule_annotation(records, found).withColumn("answer", F.lit("no json")).withColumn("failure", F.when(F.col("id") == "1", "time ran out"))
    once = annotate.apply_answers(first, "answer", TAXONOMY, "annotation.prelabel", failure_col="failure").drop("answer", "failure")
    # rules run anew, and the model is asked again
    again = annotate.with_rule_annotation(once, found).withColumn("answer", F.lit(answer()))
    rows = {r["id"]: r["annotation"] for r in annotate.apply_answers(again, "answer", TAXONOMY, "annotation.prelabel").collect()}
    assert [e["message"] for e in rows["0"]["errors"]] == ["no object"] and rows["0"]["prelabel"]["energy"]["status"] == "prelabeled"
    assert [e["message"] for e in rows["1"]["errors"]] == ["time ran out", "emotion: evidence not found in the text"] and rows["1"]["errors"][0]["stage"] == "llm"
    flat = spark.createDataFrame([("x", "no", [("llm", "old")])], "text string, answer string, errors array<struct<stage:string,message:string>>")
    flat = annotate.apply_answers(flat.withColumn("prelabel", F.struct(*[annotate.pending(d).alias(d) for d in annotate.MODEL_DIMS])), "answer", TAXONOMY)
    assert [e["message"] for e in flat.first()["errors"]] == ["old", "no object"]


def test_run_report(spark):
    docs, _, found = labels(spark, ["朝辭白帝彩雲間\n關山月", "花", "無"])
    records = docs.withColumn("metadata", F.struct(F.lit("x").alias("author"), F.lit("a").alias("annotation_method"), F.lit("b").alias("review_status")))
    out = annotate.with_rule_annotation(records, found).withColumn("answer", F.when(F.col("id") == "0", answer()))
    labelled = annotate.apply_answers(out, "answer", TAXONOMY, "annotation.prelabel")
    row = annotate.run_report(labelled, "v1", 3, 1, 2).first().asDict(recursive=True)
    assert row["records"] == 3 and row["gold_status"] == "candidate_only_until_human_review" and row["style_fields_modified"] is False
    assert row["llm"] == {"method": "llm_weak_label_v1", "complete_records": 1, "attempted_this_run": 3, "success_this_run": 1, "failed_this_run": 2}
    assert row["rules"]["imagery_empty"] == 1 and row["rules"]["imagery_label_counts"] == {"celestial": 1, "flora": 1, "frontier": 1, "landscape": 1, "travel": 1}
    assert row["rules"]["density_label_counts"] == {"sparse": 1, "medium": 1, "dense": 1}
    none = annotate.run_report(labelled.limit(0)).first()
    assert none["records"] == 0 and none["rules"]["imagery_label_counts"] == {}


def test_rule_annotation_and_resume(spark):
    docs, _, found = labels(spark, ["關山月", "花"])
    records = docs.withColumn("metadata", F.struct(F.lit("x").alias("author"), F.lit("a").alias("annotation_method"), F.lit("b").alias("review_status"))).withColumn("style", F.lit("blank"))
    out = annotate.with_rule_annotation(records, found)
    row = out.orderBy("id").first()
    assert row["metadata"]["review_status"] == "preannotated_pending_review" and row["style"] == "blank" and row["annotation"]["prelabel"]["emotion"]["status"] == "pending_llm"
    again = annotate.with_rule_annotation(out, found)
    assert again.columns.count("annotation") == 1 and again.first()["annotation"]["review"]["status"] == "pending_human_review"
    with pytest.raises(Exception, match="blank text"):
        annotate.with_rule_annotation(records.withColumn("text", F.lit(" ")), found).collect()
    with pytest.raises(ValueError):
        annotate.pending_rows(docs, F.lit(False), "id", -1)


def test_validation(spark):
    df = spark.createDataFrame([(1, "a", "qijue7"), (2, None, "qijue7"), (3, "c", "cifu")], "pos int, text string, form string")
    bad = forms.record_violations(df, ["qijue7"], "pos", ("text", "form")).orderBy("pos").collect()
    assert [(r["pos"], r["reason"]) for r in bad] == [(2, "missing text"), (3, "unknown form cifu")]


def test_prompts(spark):
    rows = [("詩", "sijo", "ZH", "KO", None), (" ", "x", "ZH", "KO", 9), ("詩", None, None, "RU", 9), ("詩", "classical", "KO", "RU", 1)]
    out = prompts.render_requests(spark.createDataFrame(rows, "text string, style string, source_lang string, target_lang string, intensity int")).collect()
    assert len(out) == 3 and "韩语" in out[0]["prompt"] and prompts.INTENSITY[3] in out[0]["prompt"] and prompts.MODERN["RU"] in out[1]["prompt"] and prompts.CLASSICAL["RU"] in out[2]["prompt"]
    label = spark.range(1).select(prompts.label_prompt(F.lit("詩"), TAXONOMY).alias("p")).first()["p"]
    assert "joy" in label and "Poem:\n詩" in label and all(r in label for r in prompts.LABEL_RULES) and label.endswith(prompts.ANSWER_SHAPE)
    told = spark.range(1).select(prompts.label_prompt(F.lit("詩"), {"energy": {"still": "靜", "wild": "狂"}}, F.lit("qijue7")).alias("p")).first()["p"]
    assert "energy: still=靜; wild=狂" in told and "Form: qijue7" in told and set(json.loads(prompts.ANSWER_SHAPE)) == set(annotate.MODEL_DIMS)
    assert spark.range(1).select(prompts.target_language(F.lit("ZH"), F.lit("ZH")).alias("t")).first()["t"] == "KO"


KOREAN = [
    "乡歌：", "形式：说明", "薯童谣서동요（四句体）", "“吏读”版本：善化", "公主主隐", "现代韩文版：선화 / 공주", "中文翻译：善化公主 / 一", "时调：",
    "原文：이 몸이 / 죽어 （郑梦周 作）", "译文：此身", "死了。", "辞说时调：", "原文：창 내고자", "译文：开窗。", "山有花", "原文：산에는", "꽃 피네", "译文：山有花", "没有标点的题", "原文：", "译文：",
]


def test_korean_entries(spark):
    docs = spark.createDataFrame([("d", i, x) for i, x in enumerate(KOREAN)], "doc string, pos int, line string")
    rows = segment.parse_documents(docs, "ko", source="s").orderBy("id").collect()
    by_id = {r["id"]: r for r in rows}
    assert set(by_id) == {"ko-hyangga-001", "ko-sijo-002", "ko-sijo-variant-003", "ko-modern-004"}
    first = by_id["ko-hyangga-001"]
    assert (first["form"], first["title_zh"], first["title_ko"], first["hyangchal"]) == ("四句体", "薯童谣", "서동요", "善化\n公主主隐") and first["text_zh"] == "善化公主 / 一"
    assert first["text_ko"] == "선화\n공주" and by_id["ko-sijo-002"]["author"] == "郑梦周" and by_id["ko-sijo-002"]["text_ko"] == "이 몸이\n죽어"
    assert first["title"] is None and by_id["ko-sijo-variant-003"]["title"] is None and by_id["ko-modern-004"]["text_ko"] == "산에는\n꽃 피네"
    assert by_id["ko-sijo-002"]["text_zh"] == "此身\n死了。" and by_id["ko-modern-004"]["title"] == "山有花"


def test_korean_oddities(spark):
    lines = ["译文：开头", "乡歌：", "译文：先有译文", "接着", "译文没有冒号", "处容歌（八句体）", "“吏读”版本：一", "现代韩文版：처음", "现代韩文版：다시", "原文 不算", "时调：", "孤句", "原文：끝"]
    docs = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)] + [("e", 0, "原文：다른 글")], "doc string, pos int, line string")
    rows = [(r["id"], r["title_zh"], r["title"], r["hyangchal"], r["text_ko"], r["text_zh"]) for r in segment.parse_documents(docs, "ko").orderBy("id", "text_ko").collect()]
    assert rows == [
        ("ko-hyangga-002", None, None, None, None, "先有译文\n接着\n译文没有冒号"),
        ("ko-hyangga-003", "处容歌", None, "一", "다시\n原文 不算", None),
        ("ko-misc-001", None, None, None, None, "开头"),
        ("ko-misc-001", None, None, None, "다른 글", None),
        ("ko-sijo-004", None, "孤句", None, "끝", None),
    ]


@pytest.mark.parametrize("mark, field", [("“吏读”版本：", "hyangchal"), ("现代韩文版：", "text_ko"), ("中文翻译：", "text_zh")])
@pytest.mark.parametrize("line", ["译文没有冒号", "原文没有冒号", "没有标记"])
def test_lines_that_go_on_with_a_field(spark, mark, field, line):
    """Only the first field of the oldest section loses a line that begins like a mark."""
    rows = [("d", i, x) for i, x in enumerate(["乡歌：", "处容歌（八句体）", mark + "一", line, "二"])]
    got = segment.parse_documents(spark.createDataFrame(rows, "doc string, pos int, line string"), "ko").first()
    lost = field == "hyangchal" and line != "没有标记"
    assert got[field] == ("一\n二" if lost else f"一\n{line}\n二")


def test_russian_entries(spark):
    lines = ["前言", "致大海①", "再见吧", "1824", "戈宝权译", "①注", "Прощай, свободная стихия", "注二", "我记得那美妙的一瞬", "俄语原文：", "Я помню", "中译文：", "我记得"]
    docs = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, pos int, line string")
    a, b = segment.parse_documents(docs, "ru", source="s").orderBy("id").collect()
    assert (a["title_zh"], a["year"], a["translator"], a["text_zh"], a["notes"], a["text_ru"]) == ("致大海①", "1824", "戈宝权", "再见吧", "①注\n注二", "Прощай, свободная стихия")
    assert (b["id"], b["text_ru"], b["text_zh"], b["year"]) == ("ru-pushkin-002", "Я помню", "我记得", None)


def test_entry_numbers(spark):
    df = spark.createDataFrame([(i,) for i in range(1001)], "pos int")
    ids = [r["id"] for r in segment.number_entries(df, ["pos"], "ko-misc").orderBy("pos").collect()]
    assert ids[0] == "ko-misc-001" and ids[-1] == "ko-misc-1001"


def test_remote(tmp_path):
    listing = [{"name": f"poet.tang.{n}.json", "download_url": f"u{n}"} for n in (1000, 0, 200)] + [{"name": "x.json", "download_url": "u"}, {"name": "poet.tang.5.json"}]
    assert [x["download_url"] for x in sources.list_shards(listing)] == ["u0", "u200", "u1000"]
    with pytest.raises(RuntimeError):
        sources.list_shards([])
    calls = []
    get = lambda u: calls.append(u) or b"[]"
    for _ in range(2):
        assert len(sources.fetch_missing(sources.list_shards(listing), str(tmp_path), get, max_files=2)) == 2
    assert sorted(calls) == ["u0", "u200"]
    with pytest.raises(RuntimeError):
        sources.fetch_missing([{"name": "bad.json", "download_url": "b"}], str(tmp_path), lambda u: b"{}")
    assert not (tmp_path / "bad.json").exists()
    waits = []

    def down(url, timeout):
        raise OSError("down")

    with pytest.raises(RuntimeError, match="down"):
        sources.http_get("u", opener=down, wait=waits.append)
    assert waits == [1, 2]


def test_windows(spark):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 2.0D as value union all select timestamp'2024-01-01 01:00:00', 'a', 3.0D")
    assert sorted(r["total"] for r in window_counts(df).collect()) == [2.0, 3.0]
