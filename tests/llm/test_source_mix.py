import math
import random
import re
from collections import Counter

import brute
import pytest

from pyspark.sql import functions as F

from ledgerlane.llm.source_mix import _crossed, mix, mix_plan, offset

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(8)
    sizes = {"a": 900, "b": 40, "Z": 200, "é": 30, None: 25}
    out = [(len(s or "") * 1000 + i, "w " * rng.randint(1, 60), "en", s) for s, n in sizes.items() for i in range(n)]
    return [*out, (5000, None, None, "a"), (5001, "", None, "empty"), (5002, " \t", None, "empty"), (5003, "x y", None, "a"), (5003, "x y", None, "a"), (None, "z", None, None)]


def test_targets_and_taken(make_docs):
    data = rows()
    got = mix_plan(make_docs(data)).collect()
    assert len(got) == len(data)
    sizes = Counter()
    for _, t, _, s in data:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute.targets(dict(sizes))
    sources = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sources.setdefault(r["target"], [0, r["source_size"]])[0] += r["taken"]
    assert sorted(sources) == pytest.approx(sorted(set(want.values())))
    for target, (taken, size) in sources.items():
        assert abs(taken - target) <= max(60, 0.02 * size)


def brute_taken(data, starts):
    """What is taken of every row, by laying the rows of each source in a line."""
    size = lambda t: len(WORDS.findall(t or ""))
    total = Counter()
    for _, t, _, s in data:
        total[s] += size(t)
    target, out = brute.targets(dict(total)), []
    for s in total:
        line = sorted(((math.floor(math.log2(size(t) + 1) * 8), i is not None, i or 0, size(t)) for i, t, _, x in data if x == s))
        each = target[s] / total[s] if total[s] else 0.0
        for rank, (_, there, i, n) in enumerate(line):
            copies = min(3, math.floor((rank + 1) * each + starts[s]) - math.floor(rank * each + starts[s]))
            out.append((i if there else None, n, total[s], copies * n))
    return out


@pytest.mark.parametrize("seed", [42, 7])
def test_plan_matches_brute_force(spark, make_docs, seed):
    data = [(i, t, lang, s) for i, t, lang, s in rows()]
    keys = {s: "-" if s is None else f"={s}" for *_, s in data}
    starts = {s: spark.range(1).select(F.lit(k).alias("source_key_")).select(offset(seed)).first()[0] for s, k in keys.items()}
    got = [(r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mix_plan(make_docs(data), seed).collect()]
    assert sorted(got, key=str) == sorted(brute_taken(data, starts), key=str)


def test_reruns_agree(make_docs):
    docs = make_docs(rows())
    key = lambda df: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in df.collect())
    assert key(mix_plan(docs)) == key(mix_plan(docs.repartition(7)))


def test_mix_emits_what_the_plan_takes(make_docs):
    docs = make_docs(rows())
    out = mix(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in mix_plan(docs).filter("size > 0 and doc_id <> 5003 and doc_id is not null").collect():
        taken[r["doc_id"]] += r["taken"] // r["size"]
    got = Counter(r["doc_id"] for r in out.collect() if WORDS.findall(r["text"] or "") and r["doc_id"] not in (5003, None))
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_empty_table(make_docs):
    docs = make_docs(rows()).limit(0)
    assert mix_plan(docs).count() == 0 and mix(docs).count() == 0


@pytest.mark.parametrize("target", [37, 100, 291])
def test_expected_copies_over_all_offsets(spark, target):
    """Whatever its rank, a document of a source of 100 words is taken target / 100 times on average."""
    n = 1000
    rows = spark.range(12).withColumnRenamed("id", "rank_").withColumns({"source_size": F.lit(100), "target": F.lit(float(target))})
    copies = rows.crossJoin(spark.range(n)).withColumn("copies", _crossed((F.col("id") + 0.5) / n))
    for r in copies.groupBy("rank_").agg(F.avg("copies").alias("mean"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect():
        assert abs(r["mean"] - target / 100) <= 2 / n and target // 100 <= r["least"] <= r["most"] <= -(-target // 100)


def test_offsets_are_spread_over_seeds(spark):
    seeds = spark.range(1).select(F.lit("=a").alias("source_key_")).select(*[offset(k).alias(f"o{k}") for k in range(400)]).first()
    assert 0 <= min(seeds) and max(seeds) < 1
    assert all(20 <= sum(k <= 10 * u < k + 1 for u in seeds) <= 60 for k in range(10))


def test_seeds_take_different_documents(make_docs):
    docs = make_docs(rows(), clash=False)
    taken = [{(r["doc_id"], r["taken"]) for r in mix_plan(docs, seed).collect()} for seed in (1, 2)]
    assert taken[0] != taken[1]
