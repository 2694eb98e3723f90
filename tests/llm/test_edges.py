"""Every operator on nulls, empty and long texts, repeated rows, ties, clashing columns and empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from stratagraph.llm import bpe_words, common, exact_dedup, language_id, mixing, near_dedup, pii, quality_rules, repair_store, suffix_lm, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, score string, id string, row string"
LONG = "the long words of a text go on " * 4000
TEXTS = [
    (1, "Plain words, here and there.\nAnd a line.\nAnd a line.", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "en", "b"), (5, "Plain words,  here and there.\nAnd a line.\nAnd a line.", "en", "b"),
    (6, "Der lange Satz und das andere Wort sind hier", "de", "b"), (6, "Der lange Satz und das andere Wort sind hier", "de", "b"), (None, "no id at all in this row", "en", "a"), (7, LONG, "en", "hot"), (8, "12345 !!! ---", None, "hot"),
    (9, "idiot says 4111111111111111 or a@b.co", "en", "hot"), (10, "日本語 Ωmega é \x00 <|endoftext|>", "en", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, 1, "x", "x", "x", "x", "x") for t in TEXTS], SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (6, None, None), (None, 1, 1), (9, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return Counter(r.doc_id for r in df.collect())


EVERY = Counter(t[0] for t in TEXTS)


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert Counter(r.doc_id for r in rows) == EVERY and exact_dedup.exact_dedup(none).count() == 0
    kept = Counter(r.doc_id for r in rows if r.kept)
    # Null, empty and blank texts: null and empty are one group, blank ones normalise to one space.
    assert kept == Counter({1: 1, 2: 1, 4: 1, 6: 1, None: 1, 7: 1, 8: 1, 9: 1, 10: 1})
    assert {r.keep_id for r in rows if r.doc_id in (1, 5)} == {1} and {r.group_size for r in rows if r.doc_id == 6} == {2}
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns and ids(out) == kept


def test_exact_dedup_by_hand(spark, monkeypatch):
    """Random texts under few ids, null ones among them, with every group hot and with none."""
    rng = random.Random(4)
    pool = ["a b", "a  b", "a\tb", "", None, " ", "long " * 200 + "x", "long " * 200 + "y", "c", "ab"]
    rows = [(rng.choice([None, *range(12)]), rng.choice(pool), k) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    best: dict = {}
    for i, t, _ in rows:
        best[norm(t)] = min(best.get(norm(t), float("inf")), float("inf") if i is None else i)
    want = Counter((i, None if best[norm(t)] == float("inf") else best[norm(t)]) for i, t, _ in rows)
    sizes = Counter(norm(t) for _, t, _ in rows)
    for least in (0, 200):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        got = exact_dedup.exact_dedup(df, carry={"norm": F.col("__norm")}).collect()
        assert Counter((r.doc_id, r.keep_id) for r in got) == want and all(r.group_size == sizes[r.norm] for r in got)
        assert Counter(r.norm for r in got if r.kept) == Counter(dict.fromkeys(sizes, 1)) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.drop_exact_copies(df).collect()
    assert Counter(norm(r.text) for r in left) == Counter(dict.fromkeys(sizes, 1))
    assert all(r.doc_id == (None if best[norm(r.text)] == float("inf") else best[norm(r.text)]) for r in left)


def test_language_decides_each_row_by_its_text(spark):
    rows = [(k, "the words of this text are plain and good", "en") for k in range(40)] + [(1, "!!!", "en"), (None, "123", None), (None, "the words of this text", None), (2, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert Counter(r.doc_id for r in language_id.keep_known_languages(df).collect()) == Counter([*range(40), None])


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGE_ROWS", 10)
    rows = [(k, "the words of this text are plain", "en") for k in range(600)] + [(1000 + k, "ñu ría zoño qué más según", "es") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.train_filters(df, train_rows=5)
    assert {r.lang_pred for r in language_id.predict_languages(df.where("lang = 'es'"), filters).collect()} == {"es"}


def test_quality(docs, none, labels):
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert set(rows) == set(EVERY) and rows[2].n_words == 0 and rows[2].base_failed and not rows[2].kept and rows[1].n_dup_lines == 1 and rows[7].n_words == 32000
    assert rows[7].n_repeat_words == 32000 and quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).count() == len(TEXTS)


def test_near_dedup(docs, none):
    rows = near_dedup.near_classes(docs).collect()
    assert Counter(r.doc_id for r in rows) == EVERY and near_dedup.near_classes(none).count() == 0
    cls = {r.doc_id: r.class_id for r in rows}
    assert cls[5] == 1 and cls[3] == cls[4] == 2 and cls[None] is None and cls[7] == 7
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_language(docs, none):
    f = language_id.train_filters(docs)
    rows = {r.doc_id: r for r in language_id.predict_languages(docs, f).collect()}
    assert set(rows) == set(EVERY) and all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (2, 3, 4, 8)) and rows[7].lang_pred == "en"
    empty = language_id.train_filters(none)
    assert {r.lang_pred for r in language_id.predict_languages(docs, empty).collect()} == {"und"} and language_id.predict_languages(none, f).count() == 0
    kept = language_id.keep_known_languages(docs)
    assert kept.columns == docs.columns and not {2, 3, 4, 8} & set(ids(kept))


def test_toxicity(docs, none, labels):
    lex = toxicity.learn_lexicon(docs, labels)
    rows = toxicity.score_toxicity(docs, lex).collect()
    assert Counter(r.doc_id for r in rows) == EVERY and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(none, toxicity.learn_lexicon(none, labels.limit(0))).count() == 0
    assert toxicity.fold_words("1D10T! Іdіоt $cum clown$$$") == ["idiot", "idiot", "scum", "clown"]
    # A learned exception: the longer phrase wins over the entry in it.
    lex = toxicity.Lexicon({" clow": 3.0, " clown  fish ": 0.0}, 1.0, 0.0)
    a = lex.automaton()
    assert toxicity._raw(["a", "clown"], a) > 0 and toxicity._raw(["a", "clown", "fish"], a) == 0


def test_pii(docs, none):
    rows = {r.doc_id: r for r in pii.find_spans(docs, pii.fit(docs)).collect()}
    assert set(rows) == set(EVERY) and [(s.kind, s.start, s.end) for s in rows[9].base] == [("card", 11, 27), ("email", 31, 37)] and rows[2].base == []
    assert pii.find_spans(none, pii.fit(none)).count() == 0


def test_suffix_lm(docs, none):
    rows = suffix_lm.score_texts(docs).collect()
    assert Counter(r.doc_id for r in rows) == EVERY and all(r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 for r in rows)
    assert suffix_lm.score_texts(none).count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = bpe_words.encode_texts(docs, path, decode=True).collect()
    assert Counter(r.doc_id for r in rows) == EVERY and bpe_words.encode_texts(none, path, decode=True).count() == 0
    text = dict((a, b) for a, b, *_ in TEXTS)
    for r in rows:
        want = t.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == t.decode(want, skip_special_tokens=False)
    back = {r.doc_id: r.decoded for r in bpe_words.decode_texts(bpe_words.encode_texts(docs, path), path).collect()}
    assert back == {r.doc_id: r.decoded for r in rows}


def test_repair(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    blocks = repair_store.write_token_blocks(docs, path, shards=5)
    rows = sorted(repair_store.read_token_blocks(blocks).collect(), key=lambda r: r.start)
    at = 0
    want = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    for r, (i, text, *_) in zip(rows, want, strict=True):
        ids_ = t.encode(text or "", add_special_tokens=False).ids + [2]
        raw = np.array(ids_, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (i, at, len(ids_), raw, zlib.crc32(raw))
        at += len(ids_)
    few = {r.doc_id: r for r in repair_store.read_documents(blocks, [5, 7, 99]).collect()}
    assert few == {r.doc_id: r for r in rows if r.doc_id in (5, 7)}
    assert repair_store.read_token_blocks(repair_store.write_token_blocks(none, path)).count() == 0


def test_repair_orders_rows_of_one_id(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k % 3 or None, f"some text {k % 7}") for k in range(60)]
    read = lambda df: [tuple(r) for r in repair_store.read_token_blocks(repair_store.write_token_blocks(df, path, shards=4)).orderBy("start").collect()]
    one = read(spark.createDataFrame(rows, "doc_id long, text string"))
    assert one == read(spark.createDataFrame(rows[::-1], "doc_id long, text string")) and [r[0] for r in one] == [None] * 20 + [1] * 20 + [2] * 20


def test_mixing(docs, none):
    rows = mixing.mix_plan(docs).collect()
    assert Counter(r.doc_id for r in rows) == EVERY and all(r.copies >= 1 for r in rows) and mixing.mix_plan(none).count() == 0
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns and ids(out) == sum((Counter({r.doc_id: r.copies}) for r in rows), Counter())
    assert mixing.mix_sources(none).count() == 0


def test_pipeline_stages(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        out.count()
        assert stage(spark, none, "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(TEXTS)


def test_words_of_contract():
    data = np.frombuffer("a\x0bb\x0c é  c".encode(), np.uint8)
    from stratagraph.llm.shingles import word_hashes

    assert len(word_hashes(data, np.array([0, len(data)]))[0]) == len(re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb\x0c é  c"))


def test_a_word_of_very_many_ids_met_twice():
    from stratagraph.llm.word_cache import UnitEncoder, UnitIds

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = UnitIds(UnitEncoder(path, False, "<u2"))
    text = "some words " + "7" * 70_000 + " and more"
    want = encoder.encoder.whole(text)
    assert len(want) > 2 * 65_536
    for _ in range(3):
        assert encoder.encode_all([text, "some words and more"]) == [want, encoder.encoder.whole("some words and more")]


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_units_are_encoded_as_whole_texts_are(name, spaces, monkeypatch):
    """Random texts of white space of every kind, marks that combine, special tokens and long words, with a memory that is soon full."""
    from stratagraph.llm.word_cache import UnitEncoder, UnitIds

    monkeypatch.setattr(UnitIds, "MOST", 40)
    rng = random.Random(1)
    parts = ["a", "b ", "\n", "\t", " ", "  ", "\x0b", "\u00a0", "\u3000", "\u2003", "é", "İ", "Σ", "'s", "don't", "12", "<|endoftext|>", "#", "%%", "日本", "\x1c", "\x85", "\u0301", "word " * 3, "x" * 70, "ẞ", "aaaa", "LL'll", "\u1680"]
    encoder = UnitIds(UnitEncoder(public_tokenizers.path(name), spaces, "<u4"))
    assert encoder.encoder.merges.ordered
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for k in range(0, len(texts), 100):
        assert encoder.encode_all(texts[k : k + 100]) == [encoder.encoder.whole(t) for t in texts[k : k + 100]]


def thue_morse(n, a, b):
    """Two words of one hash under every polynomial modulo 2 ** 64, from n = 1024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_collide_under_polynomial_hashes(spark):
    from tokenizers import Tokenizer

    x, y = thue_morse(2048, "a", "b")
    rows = [(1, x), (2, y), (3, f"{x} {y} {x}"), (4, y), (5, f"one {x}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, encode in (("word_bpe_49k.json", None), ("byte_bpe_50k.json", bpe_words.encode_texts)):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        got = encode(df, path).collect() if encode else repair_store.read_token_blocks(repair_store.write_token_blocks(df, path)).collect()
        tail = [] if encode else [2]
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: t.encode(s, add_special_tokens=False).ids + tail for i, s in rows}
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    known = {w for i, s in rows if i in train for w in s.split()}
    assert {r.doc_id: r.n_known for r in suffix_lm.score_texts(df).collect()} == {i: sum(w in known for w in s.split()) + 1 for i, s in rows}
