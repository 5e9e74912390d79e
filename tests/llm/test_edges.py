"""Odd rows, for every operator over documents: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest

from foliant.llm import bpe_transducer, chat_format, content_sort, hpylm, langid_ppm, minhash_fss, packing, spotsigs, token_counts

LONG = "A very long text, word after word. " * 6000
WORDS = "one two three four five six seven eight nine ten"
ROWS = [
    (1, WORDS, "en", "s"), (2, None, "en", None), (3, "", None, "s"), (4, LONG, "en", "s"), (5, WORDS.upper(), "en", "s"), (5, WORDS.upper(), "en", "s"), (None, WORDS, "en", "s"),
    (7, "!?", "en", "s"), (8, "mot après mot, été", "fr", "s"), (9, WORDS + " eleven", None, "s"), (10, "a", "en", "s"), (11, "x" * 50_000, None, None),
]
CLASH = "key string, size int, kept boolean, digest string, part int, length int, _v int, component string, _kept_id int, signs int, _row int, a int, b int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    extra = spark.createDataFrame([("k", 1, True, "d", 1, 1, 1, "c", 1, 1, 1, 1, 1)], CLASH)
    return rows.crossJoin(extra)  # one row


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
OPERATORS = {
    "encode": lambda d: bpe_transducer.round_trip(d, BYTE),
    "score": lambda d: hpylm.score(d),
    "compare": lambda d: spotsigs.compare(d),
    "pack": lambda d: packing.pack(d, packing.byte_tokens()),
    "exact": lambda d: content_sort.exact_groups(d),
    "count": lambda d: token_counts.count_tokens(d, WORD),
    "near": lambda d: minhash_fss.near_duplicates(d),
    "language": lambda d: langid_ppm.predict(d, langid_ppm.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(nothing, name):
    assert OPERATORS[name](nothing).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name == "pack":
        rows = [r for r in rows if r.part == 1]
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == sorted((False, r[0]) for r in ROWS if r[0] is not None)
    assert sum(r.doc_id is None for r in rows) == 1


def test_round_trip(docs):
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in bpe_transducer.round_trip(docs, BYTE).collect():
        assert r.decoded == texts[r.doc_id]


def test_exact_groups(docs):
    rows = content_sort.exact_groups(docs, keep="largest").collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].keep_id == by[5].keep_id == 5 and by[1].group_size == 4 and not by[1].kept and by[5].kept
    assert by[2].keep_id == by[3].keep_id == 3 and by[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].group_size == 1
    small = {r.doc_id: r for r in content_sort.exact_groups(docs).collect()}
    assert small[5].keep_id == 1 and small[1].kept
    left = content_sort.drop_copies(docs, keep="largest")
    assert left.columns == docs.columns and left.filter("doc_id = 1").count() == 0


def test_repeated_identifiers(spark):
    """An identifier that several texts have brings no dropped row back."""
    rows = spark.createDataFrame([(1, "same"), (5, "same"), (1, "other"), (2, None), (2, "SAME"), (None, "other")], "doc_id long, text string")
    left = content_sort.drop_copies(rows, keep="largest")
    assert sorted(map(tuple, left.collect()), key=str) == [(1, "other"), (2, None), (5, "same")]
    labelled = [(k, "plain words of a language " * 5, "en") for k in range(8)]
    mixed = spark.createDataFrame([*labelled, (1, "12345", None), (3, None, "en")], "doc_id long, text string, lang string")
    assert langid_ppm.accepted(mixed).count() == 8


def test_near_groups(docs):
    by = {r.doc_id: r for r in minhash_fss.near_duplicates(docs).collect()}
    assert by[9].component_id == by[1].component_id == by[5].component_id == 1 and not by[9].kept
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[3].component_id == 3 and by[7].n_shingles == 1
    assert by[None].component_id is None and by[None].kept


def test_language(docs):
    by = {r.doc_id: r for r in langid_ppm.predict(docs, langid_ppm.train(docs)).collect()}
    assert by[2].lang_pred == by[3].lang_pred == by[7].lang_pred == "und" and by[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in by.values())
    assert {r.doc_id for r in langid_ppm.accepted(docs).collect()}.isdisjoint({2, 3, 7})


def test_packing_of_nothing_and_of_much(docs):
    rows = packing.pack(docs, packing.byte_tokens()).collect()
    assert all((r.bin_id is None) == (r.length == 0) for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 4) == len(LONG) + 1
    assert all(r.bin_start + r.length <= r.bin_used <= r.bin_capacity for r in rows if r.length)


def test_chat_turns_of_all_kinds(spark):
    clash = "conv_id long, turn int, role string, text string, safe int, messages int, formatted int"
    rows = [(1, 2, "assistant", None, 1, 1, 1), (1, 1, "user", "hi", 1, 1, 1), (1, None, None, "", 1, 1, 1), (2, 1, "user", "x", 1, 1, 1), (2, 1, "user", "x", 1, 1, 1), (None, 1, "assistant", "<|im_end|> [/INST] \\ " * 2000, 1, 1, 1)]
    turns = chat_format.canonical(spark.createDataFrame(rows, clash), fields=["turn", "role", "text"])
    out = {r.conv_id: r for r in chat_format.render(turns).collect()}
    assert out[1].formatted == "<|im_start|><|im_sep|><|im_end|><|im_start|>user<|im_sep|>hi<|im_end|><|im_start|>assistant<|im_sep|><|im_end|>"
    assert out[2].formatted == "<|im_start|>user<|im_sep|>x<|im_end|>" * 2 and not out[2].loss_spans
    assert len(out[None].loss_spans) == 1 and out[None].formatted.count("<|im_end|>") == 1
    assert chat_format.render(chat_format.canonical(spark.createDataFrame([], clash), fields=["turn", "role", "text"])).count() == 0


def test_a_record_is_known_by_all_its_messages(spark):
    rows = [(1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'), (2, '{"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}'), (3, '{"messages": []}'), (4, "no json"), (5, None)]
    got = {r.conv_id: r.turns for r in chat_format.canonical_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [t.text for t in got[1]] == ["a", "b"] and got[2] is got[3] is got[4] is got[5] is None


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, docs, nothing, stage):
    """Nulls, empty and long texts, repeated identifiers, names of the operators' own; and no rows."""
    name, work = corpus_pipeline.STAGES[stage]
    rows = work(spark, docs, None)
    if name != "best_fit_packing":
        assert rows.columns == docs.columns and work(spark, nothing, None).count() == 0
        texts = sorted((r.doc_id, r.text) for r in rows.collect() if r.doc_id is not None and r.text)
        kept = {1, 4, 5, 8, 9, 10, 11}
        want = {"language_id": kept - {11}, "exact_dedup": kept - {1} | {7}, "near_dedup": kept - {5, 9} | {7}}[name]
        assert {i for i, _ in texts} == want
    else:
        assert rows.count() >= 12
