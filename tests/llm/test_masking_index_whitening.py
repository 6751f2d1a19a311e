"""Decontamination, fill-in-the-middle and whitening against brute force; and edge cases."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, infill, queries, whitening

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "   \n"), (None, "one two three four five six"), (None, "one two three four five six"),
    (6, "word " * 30_000), (6, "word " * 30_000), (7, "a<S>b"), (8, "<"), (9, "it's 'quoted' — ünïcödé 日本 １２ 😀<|x|>\n\n x" * 3), (10, "Ends with <M"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "c", 7, "x", "y", 1) for i, t in TEXTS], "doc_id long, text string, key string, n long, item_id string, runs string, unit int")


def cut_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# --------------------------------------------------------------------------- decontamination


def brute_hits(text, items, size=10):
    w, hit, found = cut_words(text), set(), set()
    for i, t in items:
        b = cut_words(t)
        n = min(len(b), size)
        for x in {tuple(b[k : k + n]) for k in range(max(len(b) - size + 1, 1))} if b else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == x:
                    hit.update(range(k, k + n))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_edge_cases(spark, edge):
    items = [(1, "Five SIX"), (2, None), (3, "..."), (4, "word " * 12), (None, "two three"), (4, "word " * 12), (5, "日本 １２ 😀"), (6, "nowhere to be seen"), (7, "two"), (8, "a")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(edge, bench, with_text=True).collect()
    assert len(got) == len(TEXTS)
    want = {}
    for i, t in TEXTS:
        n, hit, found = brute_hits(t, [(k, x) for k, x in items if k is not None])
        _, hit, _ = brute_hits(t, items)
        want.setdefault((i, n), []).append((hit, found))
    have = {}
    for r in got:
        have.setdefault((r["doc_id"], r["n_words"]), []).append((r["n_hit"], sorted(r["items"])))
    assert have == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[1] == "one  four " and kept[6] == " " and kept[3] == "" and [tuple(s) for s in next(r["spans"] for r in got if r["doc_id"] == 1)] == [(4, 13), (19, 27)]
    assert not decontaminate.contamination(edge.where("false"), bench).count()
    assert not decontaminate.contamination(edge, bench.where("false")).where("n_hit > 0 or size(items) > 0").count()


def test_index_over_many_shards(monkeypatch, tmp_path):
    """Few words, so windows repeat; shards and batches of items are small, so documents and items lie across them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(5)
    line = lambda n: " ".join(r.choice("abc") for _ in range(n)).encode()
    texts, items = [line(r.choice([0, 1, 3, 40, 700])) for _ in range(12)], [(k, line(r.choice([0, 2, 3, 8, 14]))) for k in range(30)]
    pq.write_table(pa.table({"item_id": [str(k) for k, _ in items], "text": [t.decode() for _, t in items]}), tmp_path / "items.parquet")
    monkeypatch.setattr(decontaminate, "SHARD", 100)
    monkeypatch.setattr(decontaminate, "BLOCK", 24)
    for batch in (60, 1_000_000):
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", batch)
        data, starts, ends, counts = decontaminate.words(texts)
        (doc, low, high), found = decontaminate.hits(data, starts, ends, counts, (str(tmp_path), ("items.parquet",)), 8)
        for d, t in enumerate(texts):
            n, hit, names = brute_hits(t.decode(), [(k, x.decode()) for k, x in items], 8)
            assert (counts[d], (high - low)[doc == d].sum(), sorted(found.get(d, ()))) == (n, hit, names)
        assert all(a[1] > b[2] for b, a in zip([*zip(doc, low, high, strict=True)], [*zip(doc, low, high, strict=True)][1:], strict=False) if a[0] == b[0])


def test_suffix_order_and_ranks():
    r = np.random.default_rng(1)
    for letters in (1, 2, 30):
        s = np.concatenate([np.concatenate([r.integers(50, 50 + letters, 60), [b]]) for b in range(40)])
        assert decontaminate.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    v = r.integers(0, 37, 500)
    tree = decontaminate.WaveletMatrix(v, 6)
    at = np.arange(500)
    before = [(v[:i] == v[i]).sum() for i in at]
    assert tree.rank(v, at).tolist() == before and [x.tolist() for x in tree.access(at)] == [v.tolist(), before]


# --------------------------------------------------------------------------- fill in the middle


def brute_infill(doc_id, text, units):
    text, n = text or "", len(units)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


@pytest.mark.parametrize(("unit", "find"), [(infill.CODE_POINT, r"(?s:.)"), (r"\w+\s*", r"(?s:\w+\s*|.)")])
def test_infill_equals_brute_force(spark, edge, unit, find):
    texts = [*TEXTS, *((i, "ab, c <" * (i % 90)) for i in range(100, 400))]
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, key string")
    got = infill.fill_in_middle(docs, unit=unit).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    rows = got.collect()
    key = lambda x: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in x)
    want = [(i, *brute_infill(i, t, re.findall(find, t or ""))) for i, t in texts if t is None or t.isascii() or unit == infill.CODE_POINT]
    have = [tuple(r)[:6] for r in rows if r["again"].isascii() or unit == infill.CODE_POINT]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert sorted((r["doc_id"] or 0, r["again"]) for r in rows) == sorted((i or 0, t or "") for i, t in texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert not infill.fill_in_middle(edge.where("false")).count()


def test_infill_edge_columns(edge):
    assert infill.fill_in_middle(edge).count() == len(TEXTS)


# --------------------------------------------------------------------------- whitening


def brute_whitening(vectors, k):
    x = np.stack([np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for v in vectors])
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(1), z @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_query_equals_brute_force(spark):
    got = queries.op13_lanczos_whitening(spark, DATA).toPandas()
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    dev, white, share = brute_whitening(e.embedding, 32)
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    sign = np.sign((table * white).sum(0))
    assert table.shape == white.shape and np.abs(table - white * sign).max() < 1e-8 and got.identity_error.max() < 1e-9 and set(got.n) == {len(e)}
    first = got[got.component == 1].set_index("vec_id").loc[e.vec_id]
    assert (first.deviation.to_numpy() == dev).all() and np.abs(got[got.vec_id == e.vec_id[0]].sort_values("component").explained.to_numpy() - share).max() < 1e-12


def test_whitening_edge_cases(spark):
    r = np.random.default_rng(2)
    good = [(i, r.standard_normal(3).tolist()) for i in range(40)]
    rows = [*good, good[0], (None, [1.0, 2.0, -3.0]), (50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 1.0, 1.0]), (53, [1.0, float("inf"), 1.0]), (54, [])]
    make = lambda rows: spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, component int")
    got = whitening.whiten(make(rows)).toPandas()
    dev, white, _ = brute_whitening([v for _, v in rows[:42]], 3)
    assert len(got) == 42 * 3 and set(got.n) == {42} and sorted(got[got.component == 2].deviation) == sorted(dev.tolist()) and got.vec_id.isna().sum() == 3
    assert np.allclose(np.sort(np.abs(got[got.component == 1].whitened)), np.sort(np.abs(white[:, 0])))
    flat = whitening.whiten(make([(i, [v[0], 1.0, 1.0]) for i, v in good])).toPandas()
    assert set(flat.component) == {1} and np.isclose(flat.explained, 1).all()
    assert not whitening.whiten(make([])).count() and not whitening.whiten(make([(1, [1.0, 2.0])] * 3)).count()
    with pytest.raises(ValueError, match="vectors of 2 to 3"):
        whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])]))


@pytest.mark.parametrize(("block", "wanted"), [(8, 12), (4, 6), (32, 32), (12, 3)])
def test_block_lanczos(block, wanted):
    """Repeated eigenvalues, a null space (breakdown) and, with small blocks, condensed bases."""
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((300, 300)))[0]
    e = np.concatenate([np.repeat([9.0, 8.0, 7.5], 4), np.linspace(5, 1, 88), np.zeros(200)])
    m = (q * e) @ q.T
    values, axes = whitening.block_lanczos(lambda x: m @ x, 300, wanted, block)
    assert np.abs(values - e[:wanted]).max() < 1e-11 and np.abs(m @ axes - axes * values).max() < 1e-11 and np.abs(axes.T @ axes - np.eye(wanted)).max() < 1e-12
