"""Operators of the training-data part: against SQL, brute force or exact round trips, and their
defined results for nulls, empty and very long texts, repeated rows, empty tables and clashing
columns."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from checks.compare import connect, difference  # noqa: E402
from skymap.llm import decontaminate, divergence, licenses, line_dedup, minhash, mixing, packed, phrase_automata, simhash, suffix_dedup, token_counts, token_output  # noqa: E402
from skymap.llm.queries import ORACLES, QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def words(rnd, n, letters="abcdefgé"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def hard_rows(seed=3):
    """Nulls, empty texts, repeats within and between texts, copies, a long text, repeated rows."""
    rnd = random.Random(seed)
    base = [words(rnd, 300) for _ in range(3)]
    texts = [None, "", " \n\t", "x" * 1500, "ab" * 900, "x " * 150, base[0], base[0], base[1], words(rnd, 30_000)]
    for _ in range(60):
        t = words(rnd, rnd.randint(0, 150))
        for _ in range(rnd.randint(0, 3)):
            if rnd.random() < 0.5:
                b = rnd.choice(base)
                a = rnd.randint(0, len(b) - 700)
                t += b[a : a + rnd.choice([390, 398, 399, 400, 401, 402, 600])]
            else:
                b = rnd.choice(base).split()
                a = rnd.randint(0, 200)
                t += rnd.choice([" ", "\n", "q"]) + " ".join(b[a : a + rnd.choice([48, 49, 50, 51, 70, 99])])
            t += rnd.choice(["", "\n", "  \t"]) + words(rnd, rnd.randint(0, 40))
        texts.append(t)
    rows = list(enumerate(texts))
    rows += [rows[6], (None, base[0]), (None, "")]
    rnd.shuffle(rows)
    return rows


def table(spark, rows):
    """The rows with columns that clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = {c: F.lit("z") for c in ("source", "row", "words", "n", "fp", "chunk", "h", "id", "key", "slot", "kept", "lines", "th")}
    return df.withColumns(extra)


def as_set(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(df, cols, want):
    assert as_set(df, *cols) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, name):
    assert difference(spark, con, SMALL, QUERIES[name], ORACLES[name]) is None


def test_suffixes(spark):
    rows = hard_rows()
    got = suffix_dedup.remove_repeats(table(spark, rows))
    same(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeats(rows))


def test_suffixes_by_bytes_not_words(spark):
    """A shared passage of 51 words stays with 399 bytes and goes, from every document, with 400."""
    words = " ".join(f"w{i:05d}" for i in range(51))
    for size, lost in ((399, 0), (400, 400)):
        passage = words.ljust(size, "z")
        got = suffix_dedup.remove_repeats(table(spark, [(i, f"{i}{passage}{'ABC'[i]}") for i in range(3)]))
        assert [r.n_removed for r in got.collect()] == [lost] * 3


def test_difference_cover():
    for r in (1, 2, 3):
        period, cover = suffix_dedup.difference_cover(r)
        assert {int(a - b) % period for a in cover for b in cover} == set(range(period))


def test_phrases(spark):
    rows = hard_rows(4)
    same(phrase_automata.remove_phrases(table(spark, rows)), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.phrases(rows))


def test_slices_within_a_long_text(spark, monkeypatch):
    data = (words(random.Random(1), 3000) * 2).encode()[:20_000]
    row = {"chunk": 0, "ids": np.zeros(1, "<i8").tobytes(), "lengths": np.array([len(data)], "<i8").tobytes(), "no_id": b"\0"}
    import zstandard

    row["data"] = zstandard.ZstdCompressor().compress(data)
    whole = suffix_dedup._samples(packed.Chunk(row))
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    cut = suffix_dedup._samples(packed.Chunk(row))
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_near_duplicates(spark):
    rnd = random.Random(8)
    base = words(rnd, 200, "abcdefg").split()
    rows = hard_rows(5)
    for i in range(200):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "w%d" % rnd.randrange(99)
        rows.append((1000 + i, " ".join(w)))
    same(simhash.near_duplicates(table(spark, rows)), ["doc_id", "fingerprint", "component_id"], brute.near_duplicates(rows))


@pytest.mark.parametrize("bucket", [2, 40])
def test_large_buckets_are_split(spark, bucket):
    rnd = random.Random(2)
    values = {0, (1 << 64) - 1}
    while len(values) < 600:
        v = rnd.choice(sorted(values)) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 4)):
            v ^= 1 << rnd.randrange(64)
        values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    roots = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), bucket=bucket)).collect()
    got = {v: v - (1 << 64) if v >> 63 else v for v in values} | {r.node % (1 << 64): r.root for r in roots}
    want = brute.components({v: 0 for v in values})
    groups = {}
    for v, r in want.items():
        groups.setdefault(r, set()).add(got[v])
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def test_keep_one(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "e f g h i"), (None, None)]
    same(simhash.keep_one(table(spark, rows)), ["doc_id", "text"], [(1, "a b c d"), (2, "e f g h i"), (None, None)])


@pytest.mark.parametrize("group", [None, 7])
def test_keep_one_of_near_copies(spark, monkeypatch, group):
    """Copies with changed words: about 0.97 to 0.6 of the shingles are the same."""
    monkeypatch.setattr(minhash, "GROUP", group or minhash.GROUP)
    rnd = random.Random(11)
    rows = []
    for k in range(12):
        base = words(rnd, rnd.randint(60, 400)).split()
        rows.append((len(rows), " ".join(base)))
        for changed in (1, 2, 3, 4, 6, 8, 12, 20):
            w = list(base)
            for _ in range(changed):
                w[rnd.randrange(len(w))] = "w%d" % rnd.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    want = [(min(rows[i][0] for i in g),) for g in brute.near_copies(rows)]
    assert 12 < len(want) < len(rows) - 40
    same(simhash.keep_one(table(spark, rows)), ["doc_id"], want)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC'0123456789 \n\t.,!?-éèüßÀΣσςИжд中文́\x1c\x85\xa0😀İ<|>"
    rows = []
    for i in range(1500):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        rows.append((i, s + "<|endoftext|>" * (rnd.random() < 0.1) if rnd.random() < 0.8 else s.replace(" ", "")))
    rows += [(None, None), (7, rows[7][1]), (9000, "a" * 5000 + words(rnd, 4000))]
    want = []
    for i, s in rows:
        n = len(library.encode(s or "", add_special_tokens=False).ids)
        want.append((i, len((s or "").encode()), n, n > 2048))
    cols = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for chunk in (1 << 16, 37):
        same(token_counts.count_tokens(table(spark, rows), chunk=chunk), cols, want)


def test_decontamination(spark):
    rnd = random.Random(6)
    question = "If a train leaves Boston at 45 km per hour and Anna walks 12 miles from Boston each day , how long until they meet ?"
    other = question.replace("45", "60").replace("12", "7").replace("Boston", "Lyon").replace("Anna", "Karl")
    mixed = other.replace("from Lyon", "from Paris")
    bench = spark.createDataFrame([(1, question), (2, words(rnd, 20)), (3, "too short"), (4, None), (5, words(rnd, 6))], "item_id long, text string")
    plain = bench.filter("item_id = 5").first().text
    rows = [(10, words(rnd, 40) + "\n" + question), (11, words(rnd, 9) + ". " + other), (12, words(rnd, 50) + " too short"), (13, None), (14, ""), (15, words(rnd, 9) + "\n" + plain), (16, words(rnd, 9) + ". " + mixed)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    # Document 16 lets one name stand for two: its slots are not consistent.
    assert got == {(10, 1), (11, 1), (15, 5)}
    left = decontaminate.drop_contaminated(table(spark, rows), bench)
    same(left, ["doc_id"], [(12,), (13,), (14,), (16,)])
    assert decontaminate.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_windows_poor_in_literals(spark):
    rnd = random.Random(16)
    title = "Annual Report Of The Royal Society Of Northern Bakers And Millers"
    items = [title.upper(), title, "1 2 3 5 8 13 21 34 55 89 144", "red green blue", "yes", "Ada Ben Cem Dora Eva Finn Gus Hana Ida Jon Kim " * 4 + "one good run of eight words is here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(10 + k, words(rnd, 20) + " " + t + " " + words(rnd, 9)) for k, t in enumerate(items[:5])]
    rows += [(20, "Yes."), (21, words(rnd, 20) + "\none good run of eight words is here"), (22, items[5])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    # Letters do not tell items 0 and 1 apart; a few windows of item 5 are no leak.
    assert got == {(10, 0), (10, 1), (11, 0), (11, 1), (12, 2), (13, 3), (20, 4), (22, 5)}


def test_decontamination_with_one_inconsistent_slot(spark):
    rnd = random.Random(17)
    start, end = words(rnd, 20), words(rnd, 20)
    name = f"{start} then Boston was seen by all of them and again old Boston {end}"
    number = "how many days do 3 boxes of weight 3 kg last when each of the men eats one"
    bench = spark.createDataFrame([(1, name), (2, number)], "item_id long, text string")
    altered = "old Paris".join(name.rsplit("old Boston", 1))
    rows = [(10, words(rnd, 9) + "\n" + altered), (11, words(rnd, 9) + "\n" + number.replace("3 boxes", "4 boxes").replace("3 kg", "5 kg"))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 2)}
    # Eight windows hold the altered name, and no others are lost.
    assert got[10, 1].n_windows - got[10, 1].n_matched == 8


def test_decontamination_without_filter(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a = as_set(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "n_matched")
    monkeypatch.setattr(decontaminate, "FILTER_HASHES", 0)
    assert a and as_set(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "n_matched") == a


def test_licenses(spark):
    text = "Copyright.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    source = licenses.SENTENCES["bsd-source"] + ".\nAll rights reserved.\n"
    binary = licenses.SENTENCES["bsd-binary"] + "."
    rows = [(1, text + source + binary), (2, binary + "\n" + source + text), (3, None), (4, "x. Released under the MIT License.\nfoo"), (5, "")]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: "BSD-2-Clause,all-rights-reserved", 2: "all-rights-reserved", 3: "", 4: "MIT", 5: ""}


MIT_WRAPPED = """MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD_WRAPPED = """/* Copyright (c) 2020 A. Body
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
 */"""
APACHE_WRAPPED = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL_WRAPPED = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_wrapped_licenses(spark):
    texts = {
        MIT_WRAPPED: "MIT",
        BSD_WRAPPED: "BSD-2-Clause",
        APACHE_WRAPPED: "Apache-2.0",
        GPL_WRAPPED: "GPL-3.0-or-later",
        GPL_WRAPPED.replace("\n", "\r\n"): "GPL-3.0-or-later",
        GPL_WRAPPED.replace("GNU General", "GNU Affero General"): "AGPL-3.0-or-later",
        "x\nLicensed under the MIT License.\ny": "MIT",
        "This work is licensed under\nCC BY 4.0": "CC-BY-4.0",
        "// SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
        " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy": "MPL-2.0",
        "All rights\n\nreserved": "",
        "Not all rights\nreserved": "",
    }
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(table(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(texts.values()))


def test_quality_cases(spark):
    rows = [(1, None), (2, ""), (3, "the cat sat on the mat and looked at the dog for a long while in the sun of that day"), (4, "a b c d e f g h " * 9), (None, "x")]
    got = {r.doc_id: r for r in divergence.quality_counts(table(spark, rows)).collect()}
    assert got[1].base_failed and got[2].n_words == 0 and got[None].base_failed
    assert got[3].kept and got[4].n_repeat_words == 72 and got[4].base_failed
    same(divergence.keep_good(table(spark, rows)), ["doc_id", "row"], [(3, "z")])


def test_lines(spark):
    rows = [(i, f" Same LINE\t\nown {i}\n\n" + "twice\n" * 2) for i in range(10)] + [(10, None), (None, "same line"), (10, None)]
    got = line_dedup.drop_common_lines(table(spark, rows))
    want = [(i, 6, 3, f"own {i}\n\n") for i in range(10)] + [(10, 1, 0, ""), (10, 1, 0, ""), (None, 1, 1, "")]
    same(got, ["doc_id", "n_lines", "n_dropped", "kept"], want)


def test_line_runs(spark):
    rnd = random.Random(3)
    batches = [[(rnd.randrange(30), 0, 1) for _ in range(40)] for _ in range(7)]
    runs = line_dedup.LineRuns(min_docs=10, fan=2)
    for b in batches:
        runs.add(spark.createDataFrame(b, "h1 long, h2 long, n_docs long"))
    total = {}
    for b in batches:
        for h, _, n in b:
            total[h] = total.get(h, 0) + n
    same(runs.frequent(), ["h1"], [(h,) for h, n in total.items() if n >= 10])


def test_exponent(spark):
    tokens = {"a": 900_000.0, "b": 60_000.0, "c": 40_000.0}
    totals = spark.createDataFrame(list(tokens.items()), "source string, tokens double")
    p = np.array(list(tokens.values())) / sum(tokens.values())

    def weights(x):
        return p**x / (p**x).sum()

    for limit in (1.1, 2.0, 5.0):
        x = mixing.exponent(totals, limit)
        assert (weights(x) / p).max() <= limit * (1 + 1e-9) and (x < 1e-5 or (weights(x - 1e-5) / p).max() > limit)
    x = mixing.exponent(totals, None, entropy=0.8)
    assert -(weights(x) * np.log(weights(x))).sum() == pytest.approx(0.8, abs=1e-4)
    assert mixing.exponent(totals, 0.5) == 1.0 and mixing.exponent(totals.limit(0)) == 1.0


def test_mixture(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, rnd.randint(1, 30)), rnd.choice(["big", "big", "big", "small", None])) for i in range(900)] + [(None, None, "none"), (5, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("z"))
    drawn = mixing.mix(docs, max_repeats=1.3, block_tokens=500).toPandas()
    own = {}
    for _, t, s in rows:
        own[s or ""] = own.get(s or "", 0) + len((t or "").split())
    total = sum(own.values())
    got = drawn.groupby("source").tokens.sum()
    x = mixing.exponent(spark.createDataFrame([(k, float(v)) for k, v in own.items() if v], "source string, tokens double"), 1.3)
    z = sum(v**x for v in own.values() if v)
    for s, v in own.items():
        assert v == 0 or 0 <= v**x / z * total - got[s] < 40
    again = mixing.mix(docs.repartition(7), max_repeats=1.3, block_tokens=500).toPandas()
    key = ["epoch", "block_order", "doc_order", "tokens"]
    assert sorted(map(tuple, drawn[key].to_numpy().tolist())) == sorted(map(tuple, again[key].to_numpy().tolist()))
    assert (drawn.groupby(["source", "doc_order"]).epoch.nunique() <= 2).all()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = token_output.slots_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 1000 or (token_output.slots_of(np.arange(n), n, 7) != slots).mean() > 0.9


def test_token_shards_round_trip(spark):
    rnd = random.Random(9)
    rows = [(i, words(rnd, rnd.randint(0, 200))) for i in range(60)] + [(None, None), (3, ""), (70, words(rnd, 5000))]
    encode, end = token_output.encoder(token_output.vocabulary_path())
    out = token_output.training_shards(table(spark, rows), length=64, per_shard=50).orderBy("shard").collect()
    want = []
    for i, t in rows:
        ids = encode(t or "") + [end]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((i, tuple(part + [end] * (64 - len(part)))))
    got = []
    for s in out:
        assert s.first_slot == s.shard * 50 and len(s.payload) == s.n_sequences * 128 and s.sha256 == hashlib.sha256(s.payload).hexdigest()
        ids = np.frombuffer(s.payload, "<u2").reshape(-1, 64)
        got += [(d, tuple(row.tolist())) for d, row in zip(s.doc_ids, ids)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    shards = spark.createDataFrame(out)
    near = {r.slot: tuple(np.frombuffer(r.ids, "<u2").tolist()) for r in token_output.read_from(shards, 45, 20, 50, 64).collect()}
    assert near == {s: got[s][1] for s in range(45, 65)}


def test_empty_tables(spark):
    none = table(spark, [(1, "a")]).limit(0)
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    for made in (
        suffix_dedup.remove_repeats(none), phrase_automata.remove_phrases(none), simhash.near_duplicates(none), simhash.keep_one(none),
        token_counts.count_tokens(none), decontaminate.contaminated(none, bench), licenses.scan_licenses(none), divergence.quality_counts(none),
        line_dedup.drop_common_lines(none), mixing.mix(none), token_output.training_shards(none),
    ):
        assert made.count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SMALL).cache()
        assert kept.columns == columns and 0 < kept.count()
        if name != "mixture":
            assert kept.select("doc_id").subtract(before.select("doc_id")).count() == 0
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    last = corpus_pipeline.run(spark, SMALL)
    assert {d for r in last.collect() for d in r.doc_ids} == ids


def test_long_white_space_is_encoded():
    """Runs that the pattern cannot take give the ids that shorter ones follow."""
    encode, _ = token_output.encoder(token_output.vocabulary_path())
    whole = token_output.LONG_RUN
    try:
        for text in ("a" + " " * 300 + "b", "\n" * 301, " " * 200 + "x" + "\t" * 250 + " y", "a" + " \n" * 400 + "\nb", " " * 300 + "7"):
            want = encode(text)
            token_output.LONG_RUN = 100
            assert token_output.encoder(token_output.vocabulary_path())[0](text) == want
            token_output.LONG_RUN = whole
    finally:
        token_output.LONG_RUN = whole
    for text in ("a" + " " * 2_000_000 + "b", "x" * 2_000_000, "\n" * 2_000_000):
        ids = encode(text)
        assert 10 < len(ids) < len(text) and sum(1 for _ in ids) == len(ids)


def test_long_white_space_in_shards(spark):
    rows = [(1, "a" + " " * 2_000_000 + "b"), (2, "x" * 2_000_000), (3, "c")]
    out = token_output.training_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_tokens for r in out) == sum(len(token_output.encoder(token_output.vocabulary_path())[0](t)) + 1 for _, t in rows)


def test_suffix_query_tells_what_is_left(spark):
    got = QUERIES["op1_suffix_dedup"](spark, SMALL)
    rows = got.select("n_bytes", "n_removed", "kept_sha256", "kept").collect()
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    same = [r for r in rows if "�" not in r.kept]
    assert len(same) > len(rows) / 2
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.encode()) == r.n_bytes - r.n_removed for r in same)
