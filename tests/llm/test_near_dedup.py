"""The pipeline's near-duplicate stage finds candidates by fingerprints."""

import random

from pyspark.sql import functions as F

from skymap.llm import minhash, simhash


def test_fingerprints_find_candidates(spark, monkeypatch):
    """Without MinHash bands, copies within three bits are still found and compared."""
    rnd = random.Random(5)
    base = ["w%d" % rnd.randrange(10**6) for _ in range(3000)]
    copy = list(base)
    copy[1500] = "other"
    texts = [" ".join(base), " ".join(copy), " ".join("v%d" % rnd.randrange(10**6) for _ in range(300))]
    assert (simhash.simhash(texts[0]) ^ simhash.simhash(texts[1])).bit_count() <= 3
    none = lambda sets: sets.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter("u <> v")
    monkeypatch.setattr(minhash, "candidates", none)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 2]
