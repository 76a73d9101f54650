"""The manifest against a plain version: hot and lone sources, nulls, ties, repeated rows, tampering."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from skymap.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source")


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("z") for c in ("tree", "idx", "n", "key", "grp", "leaf", "now", "part", "hash", "block")})


def check(spark, rows):
    got = merkle.verify_documents(table(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.merkle(rows), key=repr)


def hard_rows(seed, n_hot, n_sources):
    rnd = random.Random(seed)
    rows = [(i, "hot", rnd.choice([None, "de"]), rnd.choice([None, 3]), f"Text {i} ÄB") for i in range(n_hot)]
    rows += [(10_000 + i, f"s{i % n_sources}é", "en", i, rnd.choice([None, "", "lower", "UPPER", "Z" * 50_000])) for i in range(2 * n_sources)]
    rows += [(None, None, None, None, None), (None, "hot", "x", 1, "A"), (7, None, "x", 1, "A"), (7, None, "x", 2, "B")]
    rows += [rows[0]] * 3 + [(99_999, "lone", "x", 1, "Alone")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_levels", [1, 2])
def test_merkle(spark, monkeypatch, block_levels):
    """With blocks of 16 runs the upper nodes are stored in several copies."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    check(spark, hard_rows(5, 4500, 40))


def test_merkle_wide_top(spark, monkeypatch):
    """Over 256 sources: three levels over the subroots, none of them broadcast."""
    monkeypatch.setattr(merkle, "FEW_NODES", 0)
    check(spark, hard_rows(6, 20, 300))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_merkle_one_source(spark, n):
    check(spark, [(i, "only", "en", i, f"T{i}") for i in range(n)])


def test_merkle_two_lone(spark):
    check(spark, [(1, None, None, 1, "A"), (2, "", None, 1, "A")])


def test_merkle_empty(spark):
    assert merkle.verify_documents(table(spark, [])).count() == 0


def test_merkle_finds_changes(spark):
    """Only rows whose text has capital letters to lose fail."""
    rows = [(i, "a", "en", 1, "Cap" if i % 2 else "low") for i in range(200)]
    out = {r.doc_id: r.verified for r in merkle.verify_documents(table(spark, rows)).collect()}
    assert all(out[i] == (not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0)) for i in out)
    assert not all(out.values())
