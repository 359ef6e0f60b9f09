"""The pipeline's stages against the operators' decisions taken by hand."""

import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linkloom.llm import ngram_join, quality, secrets
from linkloom.session import table
from linkloom.storage import scratch, stored_order, written


@pytest.fixture(scope="module")
def docs(spark, awkward_docs):
    own = table(spark, "/root/testdata/sf0.01", "documents").limit(400).withColumn("doc_id", F.col("doc_id") + 10000)
    docs = awkward_docs.unionByName(own, allowMissingColumns=True)
    for clash in ("found", "kept", "row", "first", "taken", "n", "ids", "digest", "time", "readings", "__found", "__time", "__row", "__document", "__text", "__carried_x"):
        docs = docs.withColumn(clash, F.lit(clash))
    return written(docs, "test")


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, docs):
    kept = written(corpus_pipeline.quality_rules(spark, docs, ""), "test")
    assert kept.columns == docs.columns
    good = Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == good
    assert not rows(kept) - rows(docs)

    single = written(corpus_pipeline.near_duplicates(spark, kept, ""), "test")
    assert single.columns == docs.columns and not rows(single) - rows(kept)
    classes = {r.class_id for r in ngram_join.jaccard_classes(kept).collect()}
    assert Counter(r.doc_id for r in single.collect()) == Counter(classes)

    clean = written(corpus_pipeline.secret_scan(spark, single, ""), "test")
    assert clean.columns == docs.columns and clean.count() == single.count()
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in secrets.scan(clean).collect():
        assert r.spans == ""
    changed = 0
    for r in clean.collect():
        if r.text != texts[r.doc_id]:
            changed += 1
            assert "[secret]" in r.text and r.n_chars == len(r.text)
    assert changed

    mixed = written(corpus_pipeline.mix_to_weights(spark, clean, ""), "test")
    assert mixed.columns == docs.columns
    assert set(rows(mixed)) <= set(rows(clean)) and max(rows(mixed).values()) <= 2
    size, taken = defaultdict(int), defaultdict(int)
    longest = defaultdict(int)
    for into, df in ((size, clean), (taken, mixed)):
        for r in df.collect():
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            into[r.source] += n
            longest[r.source] = max(longest[r.source], n)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(longest.values())
    for s in size:
        assert taken[s] <= 2 * size[s]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.pack(spark, mixed, "").collect()
    assert sum(p.length for p in pieces) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_names_and_empty(spark, docs):
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_runs_share_nothing(spark, sf):
    """Two results of the pipeline are good at once, and stage outputs are gone with the run."""
    with scratch() as stored:
        one, two = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert rows(two) == rows(one)
    left = {p.rpartition("/")[2] for p in stored if os.path.exists(p.removeprefix("file:"))}
    assert left and all(name.startswith("linkloom-pack-") for name in left)


def test_packing_follows_the_mix(spark):
    """Shares change along the sequences as the schedules say, and a second reading is a whole reading later."""
    rng = random.Random(7)
    made = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(50, 150))), s) for i, s in enumerate("aabcc" * 300)]
    mixed = corpus_pipeline.mix_to_weights(spark, spark.createDataFrame(made, "doc_id long, text string, source string"), "")
    pieces = corpus_pipeline.pack(spark, written(mixed, "test"), "").toPandas()
    last = pieces.sequence_id.max()
    early, late = pieces[pieces.sequence_id < last * 0.25], pieces[pieces.sequence_id > last * 0.75]
    share = lambda part, s: part[part.source_key == f"0{s}"].length.sum() / part.length.sum()
    assert share(early, "a") > 1.2 * share(late, "a") and share(late, "c") > 1.2 * share(early, "c")
    pieces = pieces.sort_values(["sequence_id", "offset"])
    pieces["before"] = pieces.groupby("source_key").length.cumsum() - pieces.length
    begun = pieces[pieces.start == 0].groupby(["source_key", "doc_id"])
    twice = begun.agg(apart=("before", lambda x: x.max() - x.min()), times=("before", "size")).query("times == 2")
    reading = begun.doc_tokens.first().groupby("source_key").sum()
    assert len(twice) > 100
    for (s, _), gap in twice.apart.items():
        assert gap == pytest.approx(reading[s], rel=0.01)



def test_stored_order_is_that_of_the_rows(spark):
    """Files of very different sizes, which Spark does not read in the order of their numbers."""
    rows = spark.range(5000).select("id", F.when(F.col("id") > 3000, F.repeat(F.uuid(), 50)).alias("text")).orderBy("id")
    kept = written(rows.repartitionByRange(7, "id").sortWithinPartitions("id"), "test")
    seen = kept.select("id", stored_order(kept).alias("at")).orderBy("at").collect()
    assert [r.id for r in seen] == list(range(5000)) and len({r["at"] for r in seen}) == 5000


def test_stored_order_outlives_a_selection(spark):
    """The mix's order reaches the packing if columns or rows are left out on the way, whatever its files are called."""
    rows = spark.range(5000).select("id", F.when(F.col("id") > 3000, F.repeat(F.uuid(), 50)).alias("text")).orderBy("id")
    kept = written(rows.repartitionByRange(7, "id").sortWithinPartitions("id"), "test")
    for part in (kept.where("id % 2 = 0").withColumn("more", F.lit(1)), kept.select("id"), kept.where("id % 2 = 0").select(F.col("id"), F.upper("text").alias("text")).where("id > 5")):
        seen = part.select("id", stored_order(part).alias("at")).orderBy("at").collect()
        assert [r.id for r in seen] == sorted(r.id for r in seen) and len({r["at"] for r in seen}) == len(seen) > 1000
    folder = kept._linkloom_path.removeprefix("file:") + "-renamed"
    os.makedirs(folder)
    for file in os.listdir(kept._linkloom_path.removeprefix("file:")):
        if file.startswith("part-"):
            os.symlink(f"{kept._linkloom_path.removeprefix('file:')}/{file}", f"{folder}/data {file[5:10]}.parquet")
    renamed = spark.read.parquet(folder)
    seen = renamed.select("id", stored_order(renamed).alias("at")).orderBy("at").collect()
    assert [r.id for r in seen] == list(range(5000)) and len({r["at"] for r in seen}) == 5000
