"""Recall of near copies on a whole table: every pair of similarity 0.8 or more, found by brute force over exact shingle sets, is in one class."""

import math
import os
from collections import Counter, defaultdict

import pytest

from stratagraph.llm import near_dedup
from stratagraph.llm import shingles as S

SF = os.environ.get("NEAR_SF", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def alike(texts, least=0.8):
    """All pairs of distinct texts at least that alike. Two such sets share one of the n - least n + 1 rarest shingles of each."""
    sets = [set(map(int, S.shingle_set(t))) for t in texts]
    n = Counter(x for s in sets for x in s)
    index, pairs = defaultdict(list), []
    for k, s in enumerate(sets):
        rare = sorted(s, key=lambda x: (n[x], x))[: len(s) - math.ceil(round(least * len(s), 9)) + 1]
        seen = set()
        for x in rare:
            for j in index[x]:
                if j not in seen:
                    seen.add(j)
                    if S.jaccard(S.shingle_set(texts[j]), S.shingle_set(texts[k])) >= least:
                        pairs.append((j, k))
            index[x].append(k)
    return pairs


def test_no_pair_is_missed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = near_dedup.near_classes(docs)
    name = next(c for c in rows.columns if "class" in c)
    of = {r["doc_id"]: r[name] for r in rows.collect()}
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["text"] or "", r["doc_id"])
    ids, pairs = list(texts.values()), alike(list(texts))
    missed = [(ids[a], ids[b]) for a, b in pairs if of[ids[a]] != of[ids[b]]]
    print(f"{SF}: {len(pairs)} pairs of distinct texts, {len(missed)} missed")
    assert pairs and not missed
