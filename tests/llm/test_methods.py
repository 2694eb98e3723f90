"""The methods of toxicity, language ID and mixing against plain versions, and the pipeline against one by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from stratagraph.llm import language_id, mixing, toxicity  # noqa: E402

WORDS = [a + b for a in ("ba", "ko", "lu", "mi", "ne", "po") for b in ("", "ra", "ti", "so", "du", "fen", "gal")]


def test_toxicity_matches_are_leftmost_longest():
    """Weights found by the automaton against a search at every place, with exceptions that hold entries."""
    rng = random.Random(0)
    for _ in range(60):
        patterns = {f" {w[: rng.randint(2, 5)]}": rng.random() + 0.1 for w in rng.sample(WORDS, 6)}
        patterns |= {f" {rng.choice(WORDS)} ": rng.random() + 0.1 for _ in range(3)}
        patterns |= {f" {rng.choice(WORDS)}  {rng.choice(WORDS)} ": 0.0 for _ in range(4)}
        automaton = toxicity.Lexicon(patterns, 1.0, 0.0).automaton()
        for _ in range(20):
            words = [rng.choice(WORDS) for _ in range(rng.randint(0, 30))]
            text, total, i = toxicity._spaced(words), 0.0, 0
            while i < len(text):
                best = max((p for p in patterns if text.startswith(p, i)), key=len, default="")
                total += patterns.get(best, 0.0)
                i += max(1, len(best))
            assert abs(toxicity._raw(words, automaton) - np.log1p(1000 * total / max(20, len(words)))) < 1e-9


def test_toxicity_scores_rise_with_matches_and_ties_are_equal(spark):
    lex = toxicity.Lexicon({" vex": 2.0}, 1.5, -6.0)
    rows = [(1, "ko " * 30), (2, "vexor " + "ko " * 29), (3, "vexor vexing " + "ko " * 28), (4, "VEX0R " + "ko " * 29), (5, None), (6, "")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), lex).collect()}
    assert got[1].score == got[5].score == got[6].score < got[2].score == got[4].score < got[3].score
    for k, matches in ((1, 0), (2, 1), (3, 2)):
        x = np.log1p(1000 * 2.0 * matches / 30)
        assert abs(got[k].score - 1 / (1 + np.exp(6 - 1.5 * x))) < 1e-12 and got[k].predicted == (got[k].score >= 0.5)


@pytest.mark.parametrize("label", [0, 1])
def test_toxicity_labels_of_one_kind(spark, label):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, label) for k in range(8)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, toxicity.learn_lexicon(docs, labels)).collect()} == {0}


def grams_of(text):
    raw = f" {text.lower()} ".encode()
    letter = [97 <= b <= 122 or b >= 128 for b in raw]
    return [bytes(b if s else 32 for b, s in zip(raw[i : i + 4], letter[i : i + 4])) for i in range(len(raw) - 3) if letter[i + 1] and letter[i + 2]]


def test_language_filters_equal_exact_sets(spark):
    """Shares by bit-sliced filters against sets of n-grams, corrected by the filters' own false-positive rates."""
    rng = random.Random(1)
    sets = {"xx": ["ban", "dor", "kel", "é"], "yy": ["ñu", "ria", "zop", "ban"], "zz": ["thw", "ing", "ous", "dor"]}
    rows = [(k, " ".join("".join(rng.choice(sets[la]) for _ in range(rng.randint(1, 3))) for _ in range(12)), la) for k, la in enumerate(rng.choice(list(sets)) for _ in range(90))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    f = language_id.train_filters(df)
    import zlib

    counts = {la: Counter() for la in sets}
    for i, t, la in rows:
        if zlib.crc32(str(i).encode()) % 5:
            counts[la].update(grams_of(t))
    total = {la: sum(c.values()) for la, c in counts.items()}
    best = {g: max(counts[la][g] / total[la] for la in sets) for la in sets for g in counts[la]}
    held = {la: {g for g, n in c.items() if n >= 2 and n / total[la] >= language_id.RATIO * best[g]} for la, c in counts.items()}
    got = {r.doc_id: r for r in language_id.predict_languages(df, f).collect()}
    for i, t, _ in rows:
        grams = grams_of(t)
        score = [min(1.0, max(0.0, (sum(g in held[la] for g in grams) / len(grams) - fp) / (1 - fp))) for la, fp in zip(f.languages, f.false_positive)]
        # A gram that no language holds may pass a filter by accident, seldom enough that no share moves by a tenth.
        assert abs(got[i].score - max(score)) < 0.1 and got[i].lang_pred == f.languages[int(np.argmax(score))]


def test_language_ties_go_to_the_first_by_name(spark):
    rows = [(k, "same words for both of them here", la) for k, la in enumerate(["bb", "aa"] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.predict_languages(df, language_id.train_filters(df)).collect()} == {"aa"}


def copies_by_hand(spark, rows, budget_tokens=None, seed=mixing.SEED, max_repeats=mixing.MAX_REPEATS):
    """Copies of rows(id, text, source) from the definition of budgeted block permutations; hashes are Spark's."""
    n_of = lambda t: len((t or "").split())
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += n_of(t)
    tokens = dict(tokens)
    alpha = mixing.bisect_alpha(tokens, None, max_repeats, budget_tokens)
    weights = mixing.temperature_weights(tokens, alpha)
    budget = mixing.whole_budget(tokens, weights) if budget_tokens is None else budget_tokens
    ids = sorted({i for i, _, _ in rows})
    hashed = {r.x: r for r in spark.createDataFrame([(i,) for i in ids], "x long").select("x", F.xxhash64("x", F.lit(seed)).alias("a"), F.xxhash64("x", F.lit(seed + 2)).alias("c")).collect()}
    blocks_most = mixing.MAX_BLOCKS
    block_hash = {r.x: r.h for r in spark.range(2000).select(F.col("id").alias("x"), F.xxhash64("id", F.lit(seed + 1)).alias("h")).collect()}
    out = Counter()
    for s, n in tokens.items():
        want = budget * weights[s]
        epochs = int(want / n + 1e-9) if n else 1
        rest = max(0.0, want - epochs * n) if n else 0.0
        blocks = min(blocks_most, max(1, -(-n // mixing.BLOCK_TOKENS)))
        mine = [(i, n_of(t)) for i, t, src in rows if src == s]
        by_block: dict = {}
        for i, k in mine:
            by_block.setdefault(hashed[i].a % blocks, []).append((i, k))
        before = 0
        for b in sorted(by_block, key=lambda b: (block_hash[b], b)):
            size = sum(k for _, k in by_block[b])
            upto = 0
            whole = before + size <= rest
            for i, k in sorted(by_block[b], key=lambda x: (hashed[x[0]].c, x[0])):
                upto += k
                out[i] = epochs + (1 if k and (whole or (before < rest and before + upto <= rest)) else 0)
            before += size
    return out


def test_mixing_is_the_permutation_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    total = sum(len(t.split()) for _, t, _ in rows)
    for budget in (None, 0.4 * total, 1.7 * total):
        got = {r.doc_id: r.copies for r in mixing.mix_plan(df, budget_tokens=budget).collect()}
        want = copies_by_hand(spark, rows, budget)
        assert got == {i: want[i] for i, _, _ in rows}


def test_pipeline_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    sets = {"xx": ["ban", "dor", "kel", "mur"], "yy": ["ñu", "ria", "zop", "qua"]}
    rows = []
    for i in range(150):
        la = rng.choice(list(sets))
        kin = [t for _, t, x, _ in rows if x == la and t]
        if kin and rng.random() < 0.3:
            w = rng.choice(kin).split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "".join(rng.choice(sets[la]) for _ in range(3))
            text = ("  " if rng.random() < 0.3 else " ").join(w)
        else:
            text = " ".join("".join(rng.choice(sets[la]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 90)))
        rows.append((i, text, la, rng.choice(["web", "web", "web", "book", "code"])))
    rows += [(200, None, "xx", "web"), (201, "", "xx", "web"), (202, "123 !!!", None, "book")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    stay = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first: dict = {}
    for r in stay:
        first.setdefault(" ".join(r[1].split()), r)
    norm = lambda t: " ".join(t.split())
    stay = [r for r in stay if first[norm(r[1])] is r]
    sets_of = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (r[1].split() for r in stay)]
    top = list(range(len(stay)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(stay)):
        for j in range(i):
            if len(sets_of[i] & sets_of[j]) >= 0.8 * len(sets_of[i] | sets_of[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    stay = [r for k, r in enumerate(stay) if find(k) == k]
    assert len(stay) < len(first) < 150
    copies = copies_by_hand(spark, [(i, t, s) for i, t, _, s in stay])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: Counter = Counter()
    for i, text, _, _ in stay:
        ids = t.encode(text, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())] = copies[i]
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
