"""Encoding with spans, and decoding, against the library; normalisation against its own rules."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from skymap.llm import sentence_pieces as sp  # noqa: E402
from skymap.llm.queries import QUERIES  # noqa: E402

LETTERS = ["a", "b", "e", "n", "t", "h", "T", " ", " ", "  ", "\n", "\t", ".", ",", "0", "1", "é", "ß", "ü", "▁", "▁▁", "日本", "𝄞", "😀", " ", " ", "﻿", "\x01", "\x7f", "ffi", "①", "ｶﾞ", "é", "<s>", "</s>", "<0x41>", "<unk>", "​"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


def texts(seed=4, n=400):
    rnd = random.Random(seed)
    out = ["", " ", "  ", "\n", "▁", " ▁ a", "a" * 300, " " * 300 + "x", "x" + " " * 50, "日" * 100, "ab" * 2000]
    out += ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    return out


def test_ids_and_decoding():
    model, lib = sp.load(sp.model_path()), library()
    for t in texts():
        ids = model.encode(t)[0].tolist()
        assert ids == lib.encode(t), repr(t)
        whole = [model.bos, *ids, model.eos]
        assert model.decode(whole) == lib.decode(whole), repr(t)


def test_decoding_of_any_ids():
    """Byte pieces that make no symbol, unknown pieces, blanks first, control ids anywhere."""
    model, lib, rnd = sp.load(sp.model_path()), library(), random.Random(9)
    some = [0, 1, 2, *range(3, 259), *(rnd.randrange(259, 32000) for _ in range(300)), model.ids["▁"], model.ids["▁▁"]]
    for _ in range(3000):
        ids = [rnd.choice(some) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == lib.decode(ids), ids


def test_spans():
    """The library's places are bytes of the source, too."""
    model, lib = sp.load(sp.model_path()), library()
    for t in texts(5):
        ids, starts, ends = model.encode(t)
        data = t.encode()
        want = [(p.id, p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == want, repr(t)
        assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [True, False])
def test_character_maps(rule, extra):
    """Compiled maps of the library's own rules: normalised texts and their alignment."""
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=extra)
    model = sp.Model(lib.serialized_model_proto())
    assert (rule == "identity") == (not model.keys)
    for t in texts(6, 300):
        normal, origin = model.normalise(t)
        want, offsets = lib.normalize(t, with_offsets=True)
        assert normal == want, repr(t)
        # The library tells symbols: the source place of each normalised symbol, and of the end.
        firsts = np.cumsum([0, *(len(c.encode()) for c in normal)])
        places = {len(t[:k].encode()): k for k in range(len(t) + 1)}
        assert [places[o] for o in origin[firsts].tolist()] == list(offsets), repr(t)


def rows():
    t = texts(7, 60)
    return [*enumerate(t), (1, t[20]), (1, t[20]), (None, None), (None, "a"), (-4, None)]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("z") for c in ("ids", "starts", "ends", "n_tokens", "n_bytes", "decoded", "source")})


def wanted(rows):
    lib, out = library(), []
    for i, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode())))
    return out


def test_query_rows(spark):
    got = sp.round_trip(table(spark, rows())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(wanted(rows()), key=repr)


def test_other_columns_are_carried(spark):
    got = sp.decode(sp.encode(table(spark, rows())))
    assert got.filter("source = 'z'").count() == len(rows()) and got.columns.count("ids") == 1


def test_empty_table(spark):
    assert sp.round_trip(table(spark, [])).count() == 0


def test_long_texts(spark):
    """Two million blanks, two million letters, a long text of words."""
    rnd = random.Random(3)
    long = [(1, " " * 2_000_000), (2, "x" * 2_000_000), (3, " ".join(rnd.choice(["über", "the", "日本", "qx"]) for _ in range(400_000)))]
    got = sp.round_trip(table(spark, long)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(wanted(long))


def test_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_sentence_pieces"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(wanted([tuple(d) for d in docs]))
