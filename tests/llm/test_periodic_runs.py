"""Periodic runs against a plain version, on whole documents and on tiles small enough to cut runs."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from skymap.llm import periodic_runs as pr  # noqa: E402
from skymap.llm.queries import QUERIES  # noqa: E402

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def sequence(rnd, n, letters):
    """Words with repeated stretches, some cut, some nested, some with one word changed."""
    out = []
    while len(out) < n:
        if rnd.random() < 0.5:
            out += [rnd.choice(letters) for _ in range(rnd.randint(0, 30))]
        else:
            unit = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 16, 31, 40, 90]))]
            stretch = (unit * 40)[: rnd.randint(len(unit), 12 + 5 * len(unit))]
            if rnd.random() < 0.3:
                stretch[rnd.randrange(len(stretch))] = "x"
            out += stretch
    return out[:n]


def by_tiles(words, core, shared):
    """Runs from tiles, stitched as the operator does."""
    seen = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype="<u4")
    found = {}
    for first, end, a, b, small, large in pr.tiles(len(words), core, shared):
        for q, lo, hi in pr.solve(ids[first:end], len(words), first, (a, b), small, large):
            found.setdefault(q, set()).add((lo, hi))
    least = {}
    for q, pieces in found.items():
        whole = []
        for lo, hi in sorted(pieces):
            if whole and lo <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], hi)
            else:
                whole.append([lo, hi])
        for lo, hi in whole:
            length = hi - lo + q
            if length >= max(24, 3 * q):
                least[lo, length] = min(q, least.get((lo, length), q))
    return sorted(((a, length, q) for (a, length), q in least.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("core,shared", [(8192, 1024), (64, 8), (128, 16), (64, 32)])
def test_tiles(core, shared):
    rnd = random.Random(core + shared)
    for k in range(150):
        words = sequence(rnd, rnd.choice([0, 23, 24, 25, 60, 200, 700]), "ab" if k % 3 else "abcdefghij")
        assert by_tiles(words, core, shared) == brute.runs_of(words), (k, words)


def test_tiles_whole_periods():
    for n in (24, 500, 3000):
        for q in (1, 2, 7, 8, 9, 24, 160):
            words = [f"w{i % q}" for i in range(n)]
            assert by_tiles(words, 64, 8) == brute.runs_of(words)


def rows():
    rnd = random.Random(8)
    texts = [None, "", " \n\t", "a " * 24, "a " * 23, "x" * 5000]
    texts += [" ".join(sequence(rnd, rnd.randint(1, 300), "abcdef")) for _ in range(120)]
    texts += ["\n".join(["Same line here, again"] * 40), "é x " * 30]
    out = list(enumerate(texts))
    return out + [out[20]] * 3 + [(20, "b c " * 30), (None, texts[30]), (None, "")]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("z") for c in ("runs", "collapsed", "digest", "n", "w", "a", "first", "words", "period")})


def test_periodic_runs(spark):
    got = pr.describe_runs(pr.planted(table(spark, rows()))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.periodic(rows()), key=repr)


def test_other_columns_are_carried(spark):
    got = pr.collapse_runs(table(spark, rows()))
    assert {"digest", "words", "period"} <= set(got.columns) and got.filter("digest = 'z'").count() == len(rows())


def test_long_texts(spark):
    """Several tiles a document: short and long periods across their borders, a text of one word."""
    rnd = random.Random(2)
    free = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    a = free[:5000] + free[5000:9000] * 4 + free[9000:12000] + ["u", "v"] * 9000 + free[:30]
    want = [(5000, 16000, 4000), (24000, 18000, 2)]
    texts = [(1, " ".join(a)), (2, "z " * 40_000), (3, " ".join(free))]
    got = {r.doc_id: r for r in pr.collapse_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == want
    assert got[1].collapsed.split() == a[:9000] + a[21000:24002] + a[42000:]
    assert [tuple(r) for r in got[2].runs] == [(0, 40_000, 1)] and got[2].collapsed == "z"
    assert got[3].runs is None and got[3].collapsed == texts[2][1]


def test_empty_table(spark):
    assert pr.describe_runs(pr.planted(table(spark, []))).count() == 0


def test_documents(spark):
    """All documents of the smallest folder."""
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_periodic_runs"](spark, folder).select(*COLUMNS).collect()
    short = {i for i, t in docs if len((t or "").split()) < 3000}
    want = brute.periodic([d for d in docs if d[0] in short])
    assert sorted((tuple(r) for r in got if r.doc_id in short), key=repr) == sorted(want, key=repr)
    assert len(got) == len(docs)
