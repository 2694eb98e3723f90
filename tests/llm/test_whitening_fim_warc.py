"""Whitening, fill-in-the-middle and archives: against versions by hand, on edges, and through damaged input."""

import gzip
import hashlib
import io
import json
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import fill_in_middle as M
from stratagraph.llm import warc as A
from stratagraph.llm import whitening as W
from stratagraph.llm.queries import QUERIES
from stratagraph.plans.scratch import shared_dir


def exact(pair):
    return Fraction(float(pair[0])) + Fraction(float(pair[1]))


# Whitening -----------------------------------------------------------------------------------------


def test_error_free_transformations_lose_nothing():
    r = np.random.default_rng(1)
    a, b = r.normal(size=200) * 10.0 ** r.integers(-20, 20, 200), r.normal(size=200) * 10.0 ** r.integers(-20, 20, 200)
    s, p = W.two_sum(a, b), W.two_product(a, b, W.halves(a), W.halves(b))
    for k in range(200):
        assert exact((s[0][k], s[1][k])) == Fraction(a[k]) + Fraction(b[k])
        assert exact((p[0][k], p[1][k])) == Fraction(a[k]) * Fraction(b[k])


def test_sums_keep_what_doubles_lose():
    x = np.array([[1e16], [1.0], [-1e16], [2.0**-40], [3e16], [1.0], [-3e16]])
    assert exact([p[0] for p in W.total((x, np.zeros_like(x)))]) == 2 + Fraction(2) ** -40


def test_outer_products_equal_fractions():
    r = np.random.default_rng(2)
    x = (r.integers(0, 2048, (37, 4)) + 2**40).astype(float)
    n = len(x)
    mean = W.divided(W.total((x, np.zeros_like(x))), n)
    for i, row in W.outer_products(x, mean):
        for j in range(i, 4):
            m = [sum(Fraction(v) for v in x[:, k]) / n for k in (i, j)]
            want = sum((Fraction(a) - m[0]) * (Fraction(b) - m[1]) for a, b in zip(x[:, i], x[:, j]))
            assert abs(exact((row[0][j - i], row[1][j - i])) - want) < abs(want) * Fraction(1, 10**16) + Fraction(1, 10**12)


def test_fit_and_whiten_equal_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) + 1e6
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(7)
    model = W.fit(W.usable(rows, "v"), 4)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    assert np.allclose(model.eigenvalues, values[::-1][:4], rtol=1e-9) and model.n == 500
    assert np.allclose(np.abs(model.components @ vectors[:, ::-1][:, :4]), np.eye(4), atol=1e-6)
    out = {q["id"]: q["whitened"] for q in W.whiten(W.usable(rows, "v", {"id": F.col("id")}), model).collect()}
    want = c @ model.components.T / np.sqrt(model.eigenvalues)
    assert np.allclose([out[k] for k in range(500)], want, atol=1e-6)


def test_covariance_survives_a_huge_mean(spark):
    """Plain doubles lose every digit of a spread of 1 around 2^50."""
    x = np.random.default_rng(4).integers(0, 3, (300, 3)).astype(float)
    rows = spark.createDataFrame([((v + 2.0**50).tolist(),) for v in x], "v array<double>").repartition(5)
    model = W.fit(W.usable(rows, "v"), 3)
    c = x - x.mean(0)
    assert model.trace == pytest.approx(float((c * c).sum() / 300), rel=1e-12)
    assert W.identity_error(W.whiten(W.usable(rows, "v"), model)) < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (2, [3.0, 5.0]), (None, [0.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [4.0, -1.0])]
    rows = spark.createDataFrame([(a, b, "x", 1.0) for a, b in data], "id long, v array<double>, whitened string, vector double")
    out = W.whitened_components(rows, "id", "v", 8)
    got = out.collect()
    assert sorted((r["id"] or 0, r["component"]) for r in got) == sorted([(k, c) for k in (0, 1, 2, 2, 10) for c in (1, 2)])
    assert {r["n"] for r in got} == {5} and {r["identity_error"] < 1e-9 for r in got} == {True}
    assert sum(r["explained"] for r in got if r["id"] == 1) == pytest.approx(1.0)
    assert W.whitened_components(rows.limit(0), "id", "v", 8, {"extra": None}).columns == ["id", "component", "n", "extra", "whitened", "explained", "identity_error"]
    flat = W.whitened_components(spark.createDataFrame([(k, [2.0, 3.0]) for k in range(4)], "id long, v array<double>"), "id", "v", 8).collect()
    assert len(flat) == 8 and {(r["whitened"], r["explained"]) for r in flat} == {(None, None)}
    line = W.whitened_components(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(4)], "id long, v array<double>"), "id", "v", 8).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}


def test_op11_query_equals_fractions(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_whitening"](spark, sf).collect()
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = {k: [int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for k, v in rows.items()}
    n, dim = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(dim)]
    m = np.array([[n * v[j] - sums[j] for j in range(dim)] for v in x.values()], float) / n
    values, vectors = np.linalg.eigh(m.T @ m / n)
    project = dict(zip(x, m @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])))
    assert len(got) == 8 * n
    sign = {r["component"]: np.sign(r["whitened"] * project[r["vec_id"]][r["component"] - 1]) for r in got if r["vec_id"] == 0}
    for r in got:
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        j = r["component"] - 1
        assert r["whitened"] * sign[j + 1] == pytest.approx(project[r["vec_id"]][j], abs=1e-6)
        assert r["explained"] == pytest.approx(values[::-1][j] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


# Fill in the middle --------------------------------------------------------------------------------

_UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def by_hand(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    units = _UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in M.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", " ", "\t\n ", "a", " a", "a ", "a  b\n\nc ", "\x01\x02 \x01m \x02e\x01e\x02m", "x<P>y", "<S", "<P <S <M >", "a<S >b <P", "é 日本 🙂   x\x85y", "\x0b\x0c\x1c\x1d z", "$0 \\1 $1 \\", "w " * 5000, "<" * 50, "\x01", "\x02", "ab\x02"]


@pytest.mark.parametrize("rate, first", [(50, 80), (100, 100), (100, 0)])
def test_fill_in_middle_equals_a_version_by_hand(spark, rate, first):
    r = random.Random(rate + first)
    texts = ODD + ["".join(r.choice("ab <>PSM\n\t\x01\x02me🙂") for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "no id here", 2, "y"), (3, "two texts", 3, "z"), (3, "two texts", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, prefix string")
    out = M.fill_in_middle(df, rate=rate, suffix_first=first).withColumn("back", M.restored())
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["output"], r["back"]) for r in out.collect()), key=repr)
    want = sorted(((i, *by_hand(i, t, rate, first), t or "") for i, t, _, _ in rows), key=repr)
    assert got == want


def test_fill_in_middle_of_nothing(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fill_in_middle_runs_no_python(spark):
    plan = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Archives ------------------------------------------------------------------------------------------


def record_of(name: str, body: bytes, kind="response", **more) -> bytes:
    extra = "".join(f"{k}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def rewritten(raw: bytes):
    sink = io.BytesIO()
    return list(A.rewrite(io.BytesIO(raw), sink)), sink.getvalue()


def test_rewrite_makes_a_member_of_each_record():
    r = random.Random(7)
    bodies = [b"", b"\r\n\r\nWARC/1.1\r\n\r\n", r.randbytes(3_000_000), b"x" * 5_000_000, b"end"]
    whole = b"".join(record_of(str(k), b) for k, b in enumerate(bodies))
    mono = gzip.compress(whole)
    split = b"".join(gzip.compress(whole[k : k + 1_000_003]) for k in range(0, len(whole), 1_000_003))
    for raw in (mono, split, split + b"\0" * 600):
        entries, out = rewritten(raw)
        assert [e["id"] for e in entries] == [f"<urn:uuid:{k}>" for k in range(5)] and gzip.decompress(out) == whole
        for e, b in zip(entries, bodies):
            one = zlib.decompress(out[e["offset"] : e["offset"] + e["length"]], 31)
            assert one.endswith(b + b"\r\n\r\n") and one.startswith(b"WARC/1.1")
            assert bytes(A.parse(out[e["offset"] : e["offset"] + e["length"]])["payload"]) == b
        assert rewritten(out) == (entries, out)  # again changes nothing
    assert rewritten(gzip.compress(b"")) == ([], b"") and rewritten(b"") == ([], b"")


@pytest.mark.parametrize("damage", ["cut", "length", "head", "garbage"])
def test_damage_is_told_and_earlier_records_stay(damage):
    good = record_of("a", b"one")
    bad = {"cut": gzip.compress(good + record_of("b", b"two" * 1000))[:-40], "length": gzip.compress(good + record_of("b", b"two").replace(b"Length: 3", b"Length: 2")), "head": gzip.compress(good + b"NO WARC\r\n\r\n"), "garbage": gzip.compress(good) + b"garbage"}[damage]
    sink, seen = io.BytesIO(), []
    with pytest.raises((ValueError, KeyError, zlib.error)):
        for e in A.rewrite(io.BytesIO(bad), sink):
            seen.append(e["id"])
    assert seen == ["<urn:uuid:a>"] or damage == "cut" and seen == []


def archived(spark, rows, schema="page_id long, url string, html string, record string, payload int"):
    pages = spark.createDataFrame(rows, schema).repartition(3)
    return A.normalise(spark, A.write_monolithic(A.page_records(pages), f"{shared_dir(spark)}/mono"))


def test_pages_come_back(spark):
    long, same = "é🙂" * 400_000, "s" * 200
    html = [(1, long), (2, None), (3, ""), (4, same), (5, same), (None, same), (6, "short"), (7, "short"), (8, "y" * 100), (9, "y" * 100), (10, "z" * 99), (11, "z" * 99), (12, "a\r\n\r\nWARC/1.1\r\n\r\nb" * 20), (13, "\0\x01 bytes" * 30)]
    rows = [(i, f"https://h/{i} x\r\ny: z", h, "c", 0) for i, h in html] + [(8, "https://a", "y" * 100, "c", 0)] + [(20, None, "r" * 150, "c", 0)] * 5
    archives = archived(spark, rows)
    assert archives.where("error is not null").count() == 0
    got = A.resolved(A.read_records(archives)).collect()
    want = []
    for i, u, h, *_ in rows:
        b = (h or "").encode()
        same_bytes = [(q[0] is None, q[0] or 0, q[1] or "~") for q in rows if (q[2] or "").encode() == b]
        first = min(same_bytes)
        revisit = len(b) >= 100 and (i is None, i or 0, u or "~") != first
        want.append((str(i) if i else None, len(b), hashlib.sha256(b).hexdigest(), revisit, str(first[1]) if revisit else None))
    # Of repeated rows, one is the response.
    want = [w for w in want if w[0] != "20"] + [("20", 150, hashlib.sha256(b"r" * 150).hexdigest(), k > 0, "20" if k else None) for k in range(5)]
    assert sorted(map(repr, ((r["source"], r["payload_bytes"], r["payload_digest"], r["record_type"] == "revisit", r["refers_to_source"]) for r in got))) == sorted(map(repr, want))


def test_archives_are_plain_files(spark):
    """Every archive can be read by gzip, every sidecar line gives a member, and one record can be fetched alone."""
    archives = archived(spark, [(k, f"https://h/{k}", f"page {k} " * 50, "c", 0) for k in range(40)])
    seen = []
    for a in archives.collect():
        raw = open(a["archive"].removeprefix("file:"), "rb").read()
        lines = [json.loads(x) for x in open(a["sidecar"].removeprefix("file:"))]
        assert len(lines) == a["records"] and len(raw) == a["bytes"] == sum(x["length"] for x in lines)
        for x in lines:
            fields = A.parse(raw[x["offset"] : x["offset"] + x["length"]])
            assert fields["warc-record-id"] == x["id"] and "sha256:" + hashlib.sha256(fields["payload"]).hexdigest() == x["digest"]
            seen.append(A._bare(x["id"]))
    assert len(set(seen)) == 40
    one = A.read_records(archives, ids=[seen[7]], with_payload=True).collect()
    assert len(one) == 1 and hashlib.sha256(one[0]["payload"]).hexdigest() == one[0]["payload_digest"] == one[0]["declared_digest"]


def test_no_pages_and_damaged_archives(spark, tmp_path):
    assert A.resolved(A.read_records(archived(spark, []))).count() == 0
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record_of("a", b"one")) + gzip.compress(record_of("b", b"two"))[:-3])
    found = A.normalise(spark, str(tmp_path))
    row = found.first()
    assert row["error"].startswith("ValueError") and row["records"] in (1, 2)
    with pytest.raises(Exception, match="ends within"):
        A.read_records(found).collect()
