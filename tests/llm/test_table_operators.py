"""Operators on vectors and urls against brute force, and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import graphs, topk, urls, vectors


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16))
    near = base[:60] + rng.normal(scale=0.08, size=(60, 16))
    hot = base[0] + rng.normal(scale=0.05, size=(80, 16))
    rows = [[float(np.float32(x)) for x in v] for v in np.vstack([base, near, hot])]
    rows += [rows[5]] * 4 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [float("inf")] * 16, [1e30] * 16]
    frame = [(i, v, i % 3, "x") for i, v in enumerate(rows)] + [(None, rows[7], 0, "x"), (3, rows[3], 0, "x")]
    return spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int, class_id string").repartition(4)


@pytest.mark.parametrize("bits", [6, 12, 20])
@pytest.mark.parametrize("mean", [0, 1.5, 3])
@pytest.mark.parametrize("spread", [64, 16])
def test_tables_reach_recall(bits, mean, spread):
    """Centred, shifted and skewed vectors: the chosen tables find the pairs whatever the
    length of the keys was to be."""
    rng = np.random.default_rng(1)
    scale = np.where(np.arange(64) < spread, 1.0, 0.1)
    shift = rng.normal(size=64)
    base = rng.normal(size=(1500, 64)) * scale + shift * mean * np.linalg.norm(scale) / np.linalg.norm(shift)
    unit = np.vstack([base, base[:500] + rng.normal(size=(500, 64)) * scale * 0.45])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotations, chosen, tables = vectors.choose(unit[rng.permutation(2000)], bits, 0.9, vectors.RECALL)
    assert chosen <= bits and tables <= vectors.MOST_TABLES
    keys = rotations.keys(unit, chosen, range(tables))
    linked = np.triu(unit @ unit.T >= 0.9, 1)
    met = np.zeros_like(linked)
    for t in range(tables):
        met |= keys[:, t][:, None] == keys[:, t][None]
    assert linked.sum() > 200 and (met & linked).sum() >= 0.95 * linked.sum()


@pytest.mark.parametrize("bucket", [1, 64])
def test_vectors_with_a_common_mean(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1200, 32)) + 1.5
    rows = np.vstack([base, base[:300] + rng.normal(scale=0.5, size=(300, 32))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(rows)
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in vectors.near_vectors(frame, bucket=bucket).collect())
    assert 0.95 * true <= found <= true


def usable(v, zero):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def filled(v):
    return np.array([*v, *[0.0] * (16 - len(v))], dtype=float)


@pytest.mark.parametrize("block", [4096, 7])
def test_near_vectors(embeddings, block):
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    unit = [None if not usable(v, False) else filled(v) / np.linalg.norm(filled(v) / 1e20) / 1e20 for _, v in rows]
    linked = [
        [j for j, y in enumerate(unit) if j != i and x is not None and y is not None and x @ y >= 0.9] for i, x in enumerate(unit)
    ]
    got = vectors.near_vectors(embeddings, block=block).collect()
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in rows)
    true, found = sum(map(len, linked)), sum(r.n_links for r in got)
    assert 0.9 * true <= found <= true
    alone = {i for (i, v), ls in zip(rows, linked) if not ls and i is not None}
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id in alone)
    same = {r.vec_id: r.component_id for r in got}
    assert len({same[i] for i in range(460, 540)}) == 1 and same[540] == same[5]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


@pytest.mark.parametrize("ring, part, block", [(4096, 8192, 8192), (20, 8, 5)])
def test_top_k(embeddings, monkeypatch, ring, part, block):
    monkeypatch.setattr(topk, "RING_SIZE", ring)
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "FIRST_VISIT", 30)
    rows = [(r.vec_id, filled(r.embedding)) for r in embeddings.collect() if usable(r.embedding, True)]
    whole = [[max(-topk.LARGEST, min(topk.LARGEST, int(np.floor(64 * x)))) for x in v] for _, v in rows]
    want = Counter()
    for i, (q, _) in enumerate(rows):
        if q is not None and q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(whole[i], w)), rows[j][0] is None, rows[j][0] or 0) for j, w in enumerate(whole) if j != i]
            for rank, (score, null, v) in enumerate(sorted(scores)[: topk.K], 1):
                want[q, rank, None if null else v, max(-(2**63), min(2**63 - 1, -score))] += 1
    got = topk.top_k(embeddings, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_no_vectors(embeddings):
    assert vectors.near_vectors(embeddings.limit(0)).count() == 0
    assert topk.top_k(embeddings.limit(0), F.lit(True)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 3), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15), (4, 4)]
    got = dict(map(tuple, graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7, **dict.fromkeys(range(15, 21), 15)}


def test_url_rules(spark):
    listed = [
        None, "", "no scheme", "http://", "http://NET", "http://net/", "HTTP://A.Example.NET/en/1?x#y", "http://example.net/en",
        "ftp://a.net#f", "x://y://z/de/", "http://example.com/de/q", "http://badexample.com/de/q", "http://x.org/fr/1/2", "http://org/fr/",
        "http://a.b.example.net/en/" + "p/" * 3000, "http://h.com/a\nb/c", "http://example.com/de/q",
    ]
    frame = spark.createDataFrame([(i, u, "z") for i, u in enumerate(listed)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(frame).collect()}
    for i, url in enumerate(listed):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
        low = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (low == h or low.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1:] if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (low, path, *rule)
    assert got[0].verdict == "allow"
    assert urls.filter_urls(frame.limit(0)).count() == 0


def test_url_templates_learn(spark):
    rows = [(f"http://h.com/spam/{i}", "block") for i in range(40)] + [(f"http://h.com/good/{i}", "allow") for i in range(40)]
    rows += [(f"http://h.com/spam/{i}", None) for i in range(900, 905)] + [("http://h.com/good/77777", None)]
    rows += [(f"http://h.com/u/{chr(97 + i // 26)}{chr(97 + i % 26)}/x", "block") for i in range(60)] + [("http://h.com/u/zz/x", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, mark string")
    got = urls.filter_urls(frame, (), F.col("mark")).collect()
    verdict = {rows[r.page_id][0]: r.verdict for r in got}
    assert verdict["http://h.com/spam/900"] == "block" and verdict["http://h.com/good/77777"] == "allow"
    assert verdict["http://h.com/u/zz/x"] == "block"


def test_url_templates_of_other_hosts(spark):
    """A host without labels learns from the domain's others, and these from all; a few labels
    among very many urls without one decide nothing, nor do rare branches of other labels."""
    rows = [(f"http://h{i % 5}.a.com/de/{i}", "block") for i in range(200)] + [(f"http://h{i % 5}.a.com/en/{i}", "allow") for i in range(300)]
    rows += [("http://new.a.com/de/1", None), ("http://new.a.com/en/1", None), ("http://z.org/de/5", None), ("http://z.org/xx/5", None)]
    rows += [(f"http://big.net/p/{i}", "block" if i < 16 else None) for i in range(1000)] + [(f"http://few.net/q/{i}", "block" if i < 40 else None) for i in range(50)]
    rows += [(f"http://w.net/{chr(97 + i // 26)}{chr(97 + i % 26)}/x", "allow") for i in range(300)] + [("http://w.net/bad/x", "block")] * 5 + [("http://w.net/bad/x", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, mark string")
    got = {rows[r.page_id][0]: r.verdict for r in urls.filter_urls(frame, (), F.col("mark")).collect()}
    blocked = {u for u, v in got.items() if v == "block"}
    assert blocked == {u for u in got if "/de/" in u and "w.net" not in u or "few.net" in u}
    shapes = spark.createDataFrame([("a.x.com", "t", 10, 4, 1), ("b.x.com", "t", 3, 0, 0), ("y.org", "t", 20, 0, 20)], "host string, template string, n long, blocked long, allowed long")
    smooth = lambda n, k, a, up: (k + (4 + 0.1 * (n - k - a)) * up) / (k + a + 4 + 0.1 * (n - k - a))
    x = lambda other: smooth(*other, smooth(20, 0, 20, 0.5))
    want = {"a.x.com": smooth(10, 4, 1, x((3, 0, 0))), "b.x.com": smooth(3, 0, 0, x((10, 4, 1))), "y.org": smooth(20, 0, 20, smooth(0, 0, 0, smooth(13, 4, 1, 0.5)))}
    assert {r.host: round(r.purity, 9) for r in urls.judged_templates(shapes).collect()} == {h: round(p, 9) for h, p in want.items()}


def test_pipeline(spark, nasty, tmp_path):
    nasty.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(map(tuple, whole.select(*columns).collect())) == Counter(map(tuple, docs.select(*columns).collect()))
    ids = {r.doc_id for r in whole.collect()}
    assert {300 + i for i in range(20)} <= ids and 101 not in ids and 1 not in ids
    nasty.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
