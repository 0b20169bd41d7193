from __future__ import annotations

import random

import pytest

from quatrain.llm import spm_fst, token_count
from quatrain.llm.pieces import chunks, read_model
from quatrain.llm.queries import model_path

SIGNS = [*"abcdefghiéß  \n\t▁中文𠀀<>s/0123,.'\"=-_\x00\r　", "the", "ing", " a", "  ", "\n\n", "<s>", "</s>", "<unk>", "<0x0A>"]


def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def strings(n: int) -> list[str]:
    rnd = random.Random(6)
    out = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(40))) for _ in range(n)]
    return [*out, "", " ", "  \n", "\n", " \n ", "▁", "wordword " * 5000, "x" * 30_000, "Ünïcödé straße naïve façade"]


def test_counts_are_the_librarys():
    texts, lib = strings(4000), library()
    counts = token_count.ChunkCounts(model_path(), token_count.prove_single_tokens(model_path()), cache=80_000)
    assert counts.count(texts) == [len(ids) for ids in lib.encode(texts)]
    assert counts.count(texts[::-1]) == [len(ids) for ids in lib.encode(texts[::-1])]


def test_proven_strings_are_single_tokens():
    lib, known = library(), token_count.prove_single_tokens(model_path())
    assert len(known) > 30_000
    for chunk in random.Random(1).sample(sorted(known), 500):
        assert (len(lib.encode(chunk[1:])) if chunk[0] == " " else len(lib.encode(chunk)) - 1) == known[chunk]


def test_chunks_cover_texts():
    for t in strings(300):
        assert "".join(chunks(t)) == (" " + t.replace("▁", " ") if t else "")


def test_encoding_is_the_librarys_and_decodes():
    texts, lib = strings(4000), library()
    machine = spm_fst.PieceTransducer(read_model(model_path()), cache=300_000)
    for t, ids in zip(texts, lib.encode(texts)):
        assert machine.encode(t).tolist() == ids
        assert machine.decode(ids) == t.replace("▁", " ") == lib.decode(ids)


def test_cheapest_path_of_a_unigram_model():
    model = read_model(model_path())
    pieces = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    model.pieces, model.kinds, model.bpe = ["<unk>", *pieces], [2] + [1] * len(pieces), False
    model.scores = [0.0, -2.0, -3.1, -3.2, -2.9, -4.0, -4.2, -6.5, -4.4, -3.9]
    machine, rnd = spm_fst.PieceTransducer(model), random.Random(2)

    def cheapest(s):
        best = {0: 0.0}
        for e in range(1, len(s) + 1):
            best[e] = min(best[b] - model.scores[model.pieces.index(s[b:e])] for b in range(e) if s[b:e] in pieces)
        return best[len(s)]

    for _ in range(200):
        s = "▁" + "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        ids = machine.shortest(s)
        assert "".join(model.pieces[i] for i in ids) == s
        assert sum(-model.scores[i] for i in ids) == pytest.approx(cheapest(s))


def test_operators(spark):
    lib = library()
    rows = [(i, t.replace("\x00", ""), 7, [1]) for i, t in enumerate(strings(60))] + [(None, None, 7, [1]), (3, "again", 7, [1]), (3, "again", 7, [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids array<int>")
    got = sorted((tuple(r) for r in token_count.count_tokens(df, model_path(), limit=50).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(lib.encode(t or "")), n > 50) for d, t, *_ in rows]
    assert got == sorted(want, key=str)
    encoded = sorted((tuple(r) for r in spm_fst.encode_texts(df, model_path()).collect()), key=str)
    assert encoded == sorted(((d, lib.encode(t or ""), (t or "").replace("▁", " ")) for d, t, *_ in rows), key=str)
    assert token_count.count_tokens(df.limit(0), model_path()).count() == 0 == spm_fst.encode_texts(df.limit(0), model_path()).count()


def test_very_long_texts(spark):
    lib, rnd = library(), random.Random(11)
    words = ["".join(rnd.choice("aeiouthnsr日𠀀é,.") for _ in range(rnd.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(rnd.choice(words) for _ in range(120_000)), "q" * 200_000, "\n " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = {r["doc_id"]: (r["ids"], r["decoded"]) for r in spm_fst.encode_texts(df, model_path()).collect()}
    assert encoded == {i: (lib.encode(t), t) for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(df, model_path()).collect()}
    assert counts == {i: len(lib.encode(t)) for i, t in enumerate(texts)}


def test_texts_without_blanks_take_no_cache():
    """Each line of such a text is one chunk of thousands of signs."""
    counts = token_count.ChunkCounts(model_path(), token_count.prove_single_tokens(model_path()), cache=500_000)
    machine = spm_fst.PieceTransducer(read_model(model_path()), cache=500_000)
    size = lambda d: sum(150 + 4 * len(k) for k in d)
    proven = size(counts.proven)
    signs = "日本語中文字漢한글がな的一是"
    rnd = random.Random(7)
    for _ in range(30):
        texts = ["\n".join("".join(rnd.choice(signs) for _ in range(rnd.choice([1500, 12]))) for _ in range(5))]
        assert counts.count(texts) == [len(machine.encode(t)) for t in texts]
    for _ in range(40):
        texts = [" ".join("".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(300))]
        assert counts.count(texts) == [len(machine.encode(t)) for t in texts]
    assert size(counts) - proven < 700_000
    assert max(map(len, machine.known)) <= spm_fst.LONG_CHUNK and all(len(c) <= token_count.LONG_CHUNK for c in counts if c not in counts.proven)
    for half in (machine.known, machine.known.older):
        assert sum(200 + 4 * len(c) + len(ids) for c, ids in half.items()) < 510_000
