"""Operators against brute force on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from stratagraph.llm import dart_minhash as D  # noqa: E402
from stratagraph.llm import language_id, mixing, near_dedup, pii, quality_rules, suffix_lm, toxicity  # noqa: E402
from stratagraph.llm import repair_store as R  # noqa: E402
from stratagraph.llm import shingles as S  # noqa: E402
from stratagraph.llm.components import connected_components  # noqa: E402

WORDS = [a + b for a in ("ba", "ko", "lu", "mi", "ne", "po") for b in ("", "ra", "ti", "so", "du", "fen", "gal")]


def corpus(spark, n=120, seed=3, near=0.3):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < near:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), texts


def test_near_classes(spark):
    df, texts = corpus(spark)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split(" ") for t in texts)]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) < len(texts)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 60, dtype=np.int64).view(np.uint64)
    a, b = rng.random(60) * 3 + 0.1, rng.random(60) * 3 + 0.1
    sig = D.signatures(np.concatenate([h, h]), np.repeat([0, 1], 60), 2, 3000, np.concatenate([a, b]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    one = D.signatures(h, np.zeros(60, np.int64), 2, 125)
    assert (one[1] == 0).all() and (one[0] == D.signatures(np.concatenate([h, h]), np.zeros(120, np.int64), 1, 125)[0]).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 160)]
    top = {x: x for e in links for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_text_statistics(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "d ", "\t", "#$", "\n", "é "]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = {r.doc_id: r for r in quality_rules.text_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.n_word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_rules_are_learned(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(WORDS) + ("%%" if bad else "") for _ in range(80))))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    out = quality_rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out)


def test_pii_base_equals_patterns():
    rng = random.Random(3)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    alphabet = [*"ab.@@-_%+ 01239()é\n", "4111111111111111", "1.2.3.4", "+1 (555) 123-4567", "a@b.co", "555 "]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        want = []
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]():
                    want.append((m.start(), m.end(), k))
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_pii_gradient_is_that_of_the_likelihood():
    """Forward and backward sums against all segmentations written out."""
    n, segments = 3, [(0, 0), (0, 1), (1, 2), (2, 2)]
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(4, 4)), rng.normal(size=(5, 5))
    paths = []

    def walk(at, before, score, used):
        if at == n:
            paths.append((score, used))
            return
        walk(at + 1, 0, score + moves[before, 0], used)
        for r, (i, j) in enumerate(segments):
            if i == at:
                for k in range(4):
                    walk(j + 1, k + 1, score + moves[before, k + 1] + scores[r, k], [*used, (r, k)])

    walk(0, 0, 0.0, [])
    z = np.logaddexp.reduce([s for s, _ in paths])
    want = np.zeros((4, 4))
    for s, used in paths:
        for r, k in used:
            want[r, k] -= math.exp(s - z)
    got, _ = pii._gradient(n, segments, scores, [(0, 0, 0), (1, 1, 0), (2, 2, 0)], moves)
    assert np.allclose(got, want)


def test_pii_decoding_is_the_best_segmentation():
    """Dynamic programming against all segmentations of short texts written out, under random weights."""
    rng = np.random.default_rng(1)
    for text in ("a 1.2.3.4 b", "+1 234-5678", "j at k.l", "(555) 666 77", "a.b@c.d.e f", "b 12 34567"):
        ((atoms, segments),) = pii.regions(text)
        model = pii.Field({}, np.zeros((1, 4)), rng.normal(size=(5, 5)))
        scores = rng.normal(size=(len(segments), 4)) * 2
        model.scores = lambda *_, scores=scores: scores
        best: list = [(-math.inf, [])]

        def walk(at, before, score, used, atoms=atoms, segments=segments, scores=scores, model=model, best=best):
            if at == len(atoms):
                best.append((score, used))
                return
            walk(at + 1, 0, score + model.moves[before, 0], used)
            for r, (i, j) in enumerate(segments):
                if i == at:
                    for k in range(4):
                        walk(j + 1, k + 1, score + model.moves[before, k + 1] + scores[r, k], [*used, (atoms[i][0], atoms[j][1], pii.KINDS[k])])

        walk(0, 0, 0.0, [])
        assert sorted(model.decode(text)) == sorted(max(best)[1])


def planted(seed, n):
    """(text, start, end, kind) of values that the base patterns miss, and texts with what only looks like one."""
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    yes, no = [], []
    for k in range(n):
        card = digits(15)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        value, kind = [
            (f"{word()}.{word()} at {word()}.com", "email"), (f"{word()} (at) {word()}.org", "email"), (f"{word()} at {word()} dot net", "email"),
            (f"({digits(3)}) {digits(3)}-{digits(4)}", "phone"), (f"{digits(3)}.{digits(3)}.{digits(4)}", "phone"), (".".join(card[i : i + 4] for i in range(0, 16, 4)), "card"),
        ][k % 6]
        before = f"{word()} {word()} {rng.choice(['write to', 'call', 'reach', 'use'])} "
        yes.append((f"{before}{value} {word()} {word()}", len(before), len(before) + len(value), kind))
        no.append(f"{word()} {rng.choice([f'at {word()} and {word()}', f'version {rng.randint(1, 30)}.{rng.randint(0, 9)}.{rng.randint(256, 999)}.{rng.randint(0, 99)}', f'in {rng.randint(1800, 2030)}, page {rng.randint(1, 400)}', f'{rng.randint(1, 999)} of {rng.randint(1, 99)} at {word()}', f'cost {rng.randint(1, 99)}.{digits(2)}'])} {word()}")
    return yes, no


def trained_field():
    rng = random.Random(11)
    texts = []
    for k in range(300):
        word = lambda: rng.choice(WORDS) + rng.choice(WORDS)
        digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        card = "4" + digits(14)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        value = [f"{word()}.{word()}@{word()}.com", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", " ".join(card[i : i + 4] for i in range(0, 16, 4)), ".".join(str(rng.randrange(256)) for _ in range(4)), f"in {rng.randint(1700, 2020)} at {word()}", f"page {rng.randint(1, 300)} at {word()} and {word()}"][k % 6]
        texts.append(f"{word()} {word()} {value} {word()} {word()}")
    return pii.train_field(texts)


def test_pii_held_out_precision_and_recall():
    model = trained_field()
    yes, no = planted(5, 120)
    hit = found = 0
    for text, a, b, kind in yes:
        spans = pii.all_spans(text, model)[1]
        found += len(spans)
        hit += (a, b, kind) in spans
    wrong = sum(len(pii.all_spans(t, model)[1]) for t in no)
    assert hit / len(yes) >= 0.8 and hit / (found + wrong) >= 0.8, (hit, len(yes), found, wrong)
    assert pii.all_spans("release 1.2.3.400 is out", model)[1] == []


def test_pii_field_learns():
    texts = [f"word {a} call +1 (555) 123-{k:04d} now or mail us at user{k}@host{k}.com and pay, version {k % 9}.{k % 7} is out" for k, a in enumerate(WORDS)]
    model = pii.train_field(texts)
    spans = {(s[2]) for s in model.decode("please call (555) 987-6543 now")}
    assert spans == {"phone"} and model.decode("version 3.4 is out") == []


def test_suffix_lm(spark):
    df, texts = corpus(spark, 150, near=0)
    got = {r.doc_id: r for r in suffix_lm.score_texts(df).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in t.lower().split())
    N, V = sum(c.values()) + len(train), len(c) + 1
    log = lambda n: math.log10((n + 0.1) / (N + 0.1 * (V + 1)))
    for i, t in enumerate(texts):
        r, w = got[i], t.lower().split()
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, N) and abs(r.base_score - sum(log(c[x]) for x in w) - log(len(train))) < 1e-3
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert sum(got[i].score for i in held) > 1.2 * sum(got[i].base_score for i in held)  # not far behind on so little text


def suffix_tree_by_hand(train):
    """score(text) of the suffix tree, from dictionaries of whole contexts."""
    spell = lambda t: [*(c for w in t.split() for c in [*w.lower().encode(), 32]), 255]
    depth, n = suffix_lm.DEPTH, Counter()
    for t in train:
        s = [32] * depth + spell(t)
        for k in range(depth, len(s)):
            for d in range(depth + 1):
                n[tuple(s[k - d : k]), s[k]] += 1
    after: dict = {}
    for (context, x), c in n.items():
        after.setdefault(context, {})[x] = c
    total = {c: sum(a.values()) for c, a in after.items()}
    keep = {()} if after else set()
    for c, a in after.items():
        if c and total[c] >= suffix_lm.LEAST:
            up = after[c[1:]]
            bits = sum(m * math.log2(m / total[c] * total[c[1:]] / up[x]) for x, m in a.items())
            if bits - suffix_lm.COST * len(a) * math.log2(total[c] + 1) > 0:
                keep |= {c[k:] for k in range(len(c) + 1)}

    def p(context, x):
        if not keep:
            return 1 / 257
        while context not in keep:
            context = context[1:]
        below = p(context[1:], x) if context else 1 / 257
        a = after[context]
        return (a.get(x, 0) + len(a) * below) / (total[context] + len(a))

    def score(t):
        s = [32] * depth + spell(t)
        return sum(math.log10(p(tuple(s[k - depth : k]), s[k])) for k in range(depth, len(s)))

    return score


def test_suffix_tree_equals_one_by_hand(spark, monkeypatch):
    """Scores of every text, with all states broadcast and with most of them joined."""
    df, texts = corpus(spark, 90, near=0)
    texts = [*texts, "", "É ß, Ünder\tWORDS\nnever met", "a" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    score = suffix_tree_by_hand([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10])
    for entries in (suffix_lm.ENTRIES, 150):
        monkeypatch.setattr(suffix_lm, "ENTRIES", entries)
        got = {r.doc_id: r.score for r in suffix_lm.score_texts(df).collect()}
        assert all(abs(got[i] - score(t)) < 1e-4 * (1 + abs(got[i])) for i, t in enumerate(texts))


def test_symbols_and_runs():
    texts = ["ab  c", "", " ", "x", "long\tword \n", "y z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    code, bounds = suffix_lm.runs(*suffix_lm.symbols(data, offsets))
    for k, t in enumerate(texts):
        s = b" " * 6 + "".join(w + " " for w in t.split()).encode() + b"\xff"
        got = code[bounds[k] : bounds[k + 1]].astype(">u8").tobytes()
        assert [got[i + 1 : i + 8] for i in range(0, len(got), 8)] == [s[i - 6 : i + 1] for i in range(6, len(s))]


def test_hot_words_do_not_change_the_base(spark):
    df, _ = corpus(spark, 60)
    a = {r.doc_id: r for r in suffix_lm.score_texts(df).collect()}
    b = {r.doc_id: r for r in suffix_lm.score_texts(df, hot_words=3).collect()}
    assert all(a[k].n_known == b[k].n_known and abs(a[k].base_score - b[k].base_score) < 1e-3 for k in a)


def test_repair_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 60, 5000):
        for v, kind in ((1, np.uint16), (2, np.uint16), (5, np.uint16), (49_000, np.uint16), (5, np.uint32), (200_000, np.uint32)):
            x = rng.integers(0, v, n).astype(kind)
            sizes = rng.multinomial(n, [0.2] * 5)
            block = R.Block(R.pack_block([None, 3, 3, 5, 9], sizes, x, max(v, 49_408)))
            assert block.without_id == 1 and block.docs.tolist() == [0, 3, 3, 5, 9] and (block.sizes == sizes).all()
            assert np.array_equal(block.ids(0, 5), x)
            ends = np.cumsum(sizes)
            assert all(np.array_equal(block.ids(i, j), x[ends[i] - sizes[i] : ends[j - 1]]) for i in range(5) for j in range(i + 1, 6))
            assert np.array_equal(np.concatenate([ids for *_, ids in block.runs(7)]), x)


def test_repair_replaces_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    for x in (np.tile(np.arange(50, dtype=np.uint16), 400), np.zeros(3000, np.uint16), rng.zipf(1.5, 60_000).clip(0, 400).astype(np.uint16)):
        seq, left, right, length = R.repair(x, 49_408)
        left_over = Counter(zip(seq.tolist(), seq[1:].tolist()))
        # Pairs of one symbol may overlap themselves: half of them can be replaced.
        assert all(n < R.LEAST_COUNT for (a, b), n in left_over.items() if a != b) and len(seq) < len(x) * 0.7
        assert len(R.pack_block([1], np.array([len(x)]), x, 49_408)) < x.nbytes
        made = np.arange(49_408, 49_408 + len(left))
        assert (left < made).all() and (right < made).all() and int(length[seq[seq >= 49_408].astype(int) - 49_408].sum() + (seq < 49_408).sum()) == len(x)


def test_the_most_frequent_pair_is_replaced_first():
    """One turn of one rule against counting by hand."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 300, 200_000).astype(np.uint16)
    x[rng.choice(100_000, 900, replace=False) * 2] = 7
    pairs = Counter(zip(x.tolist(), x[1:].tolist()))
    _, left, right, _ = R.repair(x, 49_408)
    assert pairs[int(left[0]), int(right[0])] == max(pairs.values())


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 30)), "hot" if i % 3 else f"s{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df, max_repeats=2.0).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    alpha = mixing.bisect_alpha(dict(tokens), max_repeats=2.0)
    w = mixing.temperature_weights(dict(tokens), alpha)
    budget = mixing.whole_budget(dict(tokens), w)
    assert mixing.repeats(dict(tokens), w, budget) <= 2 + 1e-9
    for s in tokens:
        have = sum(r.n_tokens * r.copies for r in got if r.source == s)
        assert have <= budget * w[s] + 1e-6 and have > budget * w[s] - 31
    assert all(r.copies >= 1 for r in got)
    h = mixing.bisect_alpha({"a": 900, "b": 100}, target_entropy=0.8)
    assert abs(mixing.entropy(mixing.temperature_weights({"a": 900, "b": 100}, h)) - 0.8) < 1e-9
    half = mixing.mix_plan(df, budget_tokens=0.5 * sum(tokens.values())).collect()
    assert min(r.copies for r in half) == 0


def test_language_held_out(spark):
    rng = random.Random(6)
    sets = {"xx": ["ban", "dor", "kel"], "yy": ["ñu", "ria", "zop"], "zz": ["thw", "ing", "ous"]}
    rows = [(i, " ".join("".join(rng.choice(sets[la]) for _ in range(rng.randint(1, 3))) for _ in range(20)), la) for i, la in enumerate(rng.choice(list(sets)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(df, language_id.train_filters(df)).collect()}
    assert sum(got[i] == la for i, _, la in rows) >= 298


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.3
        w = [rng.choice(WORDS) for _ in range(60)]
        if bad:
            w[rng.randrange(60)] = rng.choice(["vexor", "v3xor", "VEXOR", "vexorian"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, toxicity.learn_lexicon(docs, lab)).collect()}
    assert sum(got[i] == y for i, y in labels) >= 495


def test_shingles_are_five_words():
    a = S.shingle_set("a b c d e f")
    assert len(a) == 2 and len(S.shingle_set("a b")) == 1 and len(S.shingle_set("")) == 0 and S.jaccard(a, S.shingle_set("a  b\tc d e f")) == 1.0


def test_field_reads_an_email_without_digits_or_sign():
    names = [a + b for a, b in zip(WORDS, reversed(WORDS))]
    model = pii.train_field([f"please write to {a}.{b} @{k} or {a}.{b}@{b}{a}.com today" if k % 5 == 0 else f"please write to {a}.{b}@{b}{a}.com today" for k, (a, b) in enumerate(zip(names, WORDS))] + [f"we met at {a} and {b} at home" for a, b in zip(names, WORDS)])
    for at in ("at", "AT", "At"):
        text = f"please write to joe.smith {at} example.com today"
        base, spans = pii.all_spans(text, model)
        assert base == [] and [(text[a:b], kind) for a, b, kind in spans] == [(f"joe.smith {at} example.com", "email")]
    assert pii.all_spans("we met at noon and sat at home", model) == ([], [])


def test_a_row_that_matched_its_leader_links_others(spark, monkeypatch):
    """1 leads its only bucket, 2 is like 1 and 3, and 3 is not like 1."""
    monkeypatch.setattr(near_dedup, "band_keys", lambda sig, bands, rows: np.tile(np.arange(bands), (len(sig), 1)))
    w = [f"w{k}" for k in range(100)]
    texts = [w, [*w[:-6], *[f"x{k}" for k in range(6)]], [*[f"y{k}" for k in range(6)], *w[6:-6], *[f"x{k}" for k in range(6)]], [f"z{k}" for k in range(50)]]
    docs = spark.createDataFrame([(k + 1, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def drifting(n, seed, words=120):
    """Versions of versions of a text, each a few words away from one before it."""
    rng = random.Random(seed)
    texts = [[f"w{k}" for k in range(words)]]
    while len(texts) < n:
        w = list(rng.choice(texts))
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    return [" ".join(w) for w in texts]


def components_of(texts, weigh):
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    if not weigh:
        bags = [Counter(dict.fromkeys(b, 1)) for b in bags]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in range(len(texts))}


def test_near_classes_of_drifting_copies_in_small_blocks(spark, monkeypatch):
    """Groups whose members are seldom like their leader; blocks of a few rows, so that components span them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    texts = [t for seed in range(3) for t in drifting(40, seed)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()}
    want = components_of(texts, False)
    assert got == want and 3 < len(set(want.values())) < len(texts)


def test_near_classes_by_weights(spark):
    """Repeated passages: alike as sets, not by counts."""
    rng = random.Random(9)
    body = [[rng.choice(WORDS) for _ in range(60)] for _ in range(8)]
    texts = []
    for b in body:
        texts += [" ".join(b), " ".join(b[:20] * 9 + b), " ".join(b[:20] * 10 + b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    for weights in ("set", "count"):
        got = {r.doc_id: r.class_id for r in near_dedup.near_classes(df, weights=weights).collect()}
        assert got == components_of(texts, weights == "count")
    assert components_of(texts, False) != components_of(texts, True)


def test_one_id_over_different_texts(spark):
    rows = [(5, "one text of id five that stands alone here"), (5, "another text which id six holds as well today"), (6, "another text which id six  holds as well today"), (7, "a third text of quite different words entirely")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int")
    out = near_dedup.near_classes(df).collect()
    assert len({r.class_key for r in out}) == 3 and sorted((r.doc_id, r.class_id, r.class_size) for r in out) == [(5, 5, 1), (5, 5, 2), (6, 5, 2), (7, 7, 1)]
    assert sorted(r.n for r in near_dedup.drop_near_copies(df).collect()) == [0, 1, 3]
    swapped = spark.createDataFrame([(4 if i == 6 else i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    assert sorted(r.n for r in near_dedup.drop_near_copies(swapped).collect()) == [0, 2, 3]
