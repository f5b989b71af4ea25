"""Token counts, fill-in-middle and centroids against the library and brute force."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from math import floor, isfinite

import pytest

from codeloom.llm import centroids, infilling, tokencount

PARTS = [
    "a", "b", "the", " ", " ", "  ", "\n", "\t", "'s", "'re", "'r", "'", "'ll", "'v", "x", "1", "23", "é", "ß", "日本", "語", "!", "..",
    "　", " ", "😀", "<|endoftext|>", "<|", "İ", "½", "_", "-", "ing", "tion", "A", "\r\n", "\x85", "\x1c", "e", "नम", "٣",
]


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        kind = rng.random()
        if kind < 0.5:
            yield "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 90)))
        elif kind < 0.75:
            yield rng.choice(["a", " ", "-", "ab", "\n", "日", "0", "the", "'", "'s"]) * rng.randint(1, 300)
        else:
            yield "".join(rng.choice("abetaoinrs") for _ in range(rng.randint(1, 200)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokencount.vocabulary_path())
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def compiled():
    return tokencount.Machine(tokencount.vocabulary_path())


def test_transducer(compiled, library):
    for text in texts(1, 1500):
        assert compiled.count(text) == library(text), text
        at = len(text) // 3
        key, head = compiled.run(tokencount.START, text[:at]) if "<" not in text else (None, 0)
        if key:
            assert head == library(text[:at]) and head + compiled.read_on(key, text[at:])[1] == library(text), text


def test_state_maps(compiled, library):
    rng = random.Random(2)
    for text in texts(3, 800):
        size, block = rng.choice([3, 7, 20]), rng.choice([2, 3, 8])
        cuts = list(tokencount.cuts(text, compiled.added, size))
        assert "".join(text[a:b] for a, b in cuts) == text
        maps = [compiled.state_map(text[a:b], text[max(0, a - 256) : a], a == 0) for a, b in cuts]
        while len(maps) > 1:
            whole = []
            for i in range(0, len(maps), block):
                whole.append(maps[i])
                for other in maps[i + 1 : i + block]:
                    whole[-1] = compiled.composed(whole[-1], other)
            maps = whole
        assert not maps or maps[0][1] == library(text), text


def documents(spark, nasty):
    odd = spark.createDataFrame([(900 + i, t) for i, t in enumerate(texts(4, 60))], "doc_id long, text string")
    return nasty.unionByName(odd, allowMissingColumns=True)


def test_starting_anew(compiled, library, monkeypatch):
    monkeypatch.setattr(tokencount, "COMPILED", 50)
    monkeypatch.setattr(tokencount, "STRETCHES", 50)
    for text in texts(6, 100):
        assert compiled.count(text) == library(text)
        compiled.tidy()
        assert compiled.size + len(compiled.may) <= 50 >= len(compiled.counts)


@pytest.mark.parametrize("chunk, block, context", [(1 << 16, 64, 256), (50, 3, 256), (40, 4, 0)])
def test_token_counts(spark, nasty, library, monkeypatch, chunk, block, context):
    # Without context no table knows a state, so that the stream has to count.
    monkeypatch.setattr(tokencount, "CONTEXT", context)
    docs = documents(spark, nasty)
    want = Counter((r.doc_id, len((r.text or "").encode()), library(r.text or "")) for r in docs.select("doc_id", "text").collect())
    got = tokencount.count_tokens(docs, chunk=chunk, block=block)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_only_plain_tokenizers(tmp_path):
    with pytest.raises(ValueError):
        tokencount.Machine(tokencount.vocabulary_path("word_bpe_49k.json"))


def infilled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("chunk, scan", [(1 << 15, 1 << 20), (7, 11)])
def test_fill_in_middle(spark, nasty, monkeypatch, chunk, scan):
    monkeypatch.setattr(infilling, "SCAN", scan)
    rows = [(700 + i, t) for i, t in enumerate(["a<b", "<", "<<S", "x <P> y", "P><S", "<<<>>>", "<M", "ab😀\x00é<"])]
    odd = spark.createDataFrame(rows, "doc_id long, text string")
    docs = documents(spark, nasty).unionByName(odd, allowMissingColumns=True)
    docs = docs if chunk > 7 else docs.where("text IS NULL OR length(text) < 2000")
    want = [(r.doc_id, r.text or "", infilled(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    made = infilling.pieces(docs, chunk=chunk)
    got = infilling.digests(infilling.assembled(made)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *w[:4], sha(w[4]), sha(t)) for i, t, w in want)
    assert {w[1] for _, _, w in want} == {"plain", "psm", "spm"}
    got = infilling.fill_in_middle(docs, chunk=chunk).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, _, w in want)


def test_units_by_blocks(monkeypatch):
    for text in texts(5, 200):
        starts = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S)]
        for scan in (1, 5, 1 << 20):
            monkeypatch.setattr(infilling, "SCAN", scan)
            assert infilling.count_units(text) == len(starts)
            places = [*starts, len(text)]
            assert infilling.unit_places(text, [len(starts) // 3, len(starts)]) == [places[len(starts) // 3], len(text)]


def test_pieces_end_at_units(spark):
    text = "word " * 30 + "z" * 50
    found = infilling.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), rate=0, chunk=12).orderBy("place").collect()
    assert "".join(r.piece for r in found) == text and max(len(r.piece) for r in found) <= 12
    assert all(a.piece[-1] == " " or b.piece[0] in " z" for a, b in zip(found, found[1:]))


def clustered(rows, clusters, rounds, width):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == width and all(x is not None and isfinite(x) for x in vector):
            kept.append((vec_id, [floor(64 * Fraction(x)) for x in vector]))
    digest = lambda vec_id: hashlib.sha256(f"1:{'' if vec_id is None else vec_id}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), max(map(abs, r[1])) <= centroids.NARROW, r[1]))[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centres)]
    return Counter((vec_id, n, d if d < 2**63 else None) for vec_id, v in kept for d, n in [nearest(v)]), centres


def vectors(wide):
    rng = random.Random(7)
    middle = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in middle[i % 6]]) for i in range(500)]
    rows += [(1000 + i, middle[0]) for i in range(40)] + [(5, middle[1]), (5, middle[1]), (5, middle[2]), (None, middle[3]), (None, None)]
    rows += [(2000, []), (2001, [1.0] * 19), (2002, [None] + [1.0] * 19), (2003, [float("nan")] * 20), (2004, [float("inf")] * 20), (2005, [0.0] * 20)]
    if wide:
        rows += [(3000, [1e30] * 20), (3001, [-1e30] * 20), (3002, [3e6] * 20), (3003, [1e12] + [0.0] * 19)]
    return [(i, v and [None if x is None else x for x in v], "x") for i, v in rows]


@pytest.mark.parametrize("wide", [False, True])
def test_centroids(spark, wide):
    rows = vectors(wide)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").repartition(5)
    want, centres = clustered([r[:2] for r in rows], 7, 3, 20)
    got, found = centroids.cluster(frame, clusters=7, width=20)
    assert found == centres
    assert Counter(tuple(r) for r in got.collect()) == want


def test_few_vectors(spark):
    rows = [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x"), (3, [-5.0, 0.015], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    got, found = centroids.cluster(frame, width=2)
    assert len(found) == 3 and {r.distance for r in got.collect()} == {0}
    got, found = centroids.cluster(frame.limit(0), width=2)
    assert found == [] and got.count() == 0


def test_no_documents(empty):
    assert tokencount.count_tokens(empty).count() == 0
    assert infilling.digests(infilling.assembled(infilling.pieces(empty))).count() == 0
    assert infilling.fill_in_middle(empty).count() == 0
