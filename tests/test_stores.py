"""Versions, resumable vectors, masking in the row, numbering of codes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from deskmill.functions import links
from deskmill.operators import privacy, vectors
from deskmill.session import workspace
from deskmill.streaming.refresh import Versions, refresh


def scan(spark, files):
    return spark.createDataFrame([("r", str(k), t, len(v), v) for k, (t, v) in files.items()],
                                 "repo string, path string, mtime long, size long, text string")


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_a_refresh_writes_what_changed(spark):
    rnd = random.Random(1)
    files = {k: (1, " ".join(str(rnd.random()) for _ in range(200))) for k in range(400)}
    versions = Versions(spark, workspace(spark, "index"))
    refresh(versions, scan(spark, files).coalesce(1))
    first = versions.current()
    whole = size_of(f"{versions.root}/chunks/version={first}")
    before = sorted(map(tuple, versions.read("chunks", first).collect()))
    files[7] = (2, "changed text of file seven")
    files[8] = (2, files[9][1])
    del files[11]
    files[999] = (1, "a new file")
    states = dict(refresh(versions, scan(spark, files).coalesce(1)).filter("state <> 'unchanged'").select("path", "state").collect())
    assert states == {"7": "changed", "8": "changed", "11": "removed", "999": "new"}
    second = versions.current()
    assert size_of(f"{versions.root}/chunks/version={second}") < whole / 20
    assert sorted(map(tuple, versions.read("chunks", first).collect())) == before
    plain = Versions(spark, workspace(spark, "index"))
    refresh(plain, scan(spark, files))
    now = lambda v, n: sorted(map(tuple, v.read(n, v.current()).collect()))
    for name in ("files", "chunks"):
        assert now(versions, name) == now(plain, name)
    refresh(versions, scan(spark, files))
    assert versions.current() == second  # nothing changed, nothing written
    files[7] = (3, "changed once more")
    refresh(versions, scan(spark, files))
    files[11] = (5, "back again")
    refresh(versions, scan(spark, files))
    assert {r.path for r in versions.read("files", versions.current()).collect()} == {str(k) for k in files}
    expected = now(versions, "chunks")
    assert versions.compact(["files", "chunks"]) == versions.current() and now(versions, "chunks") == expected
    assert versions.parts(versions.current()) == [versions.current()]


def test_a_version_without_its_row_does_not_count(spark):
    versions = Versions(spark, workspace(spark, "index"))
    refresh(versions, scan(spark, {1: (1, "one")}))
    now = versions.current()
    scan(spark, {2: (1, "two")}).write.parquet(f"{versions.root}/chunks/version={now + 1}")  # a refresh that died
    assert versions.current() == now and versions.read("files", now).count() == 1
    refresh(versions, scan(spark, {1: (1, "one"), 3: (1, "three")}))
    assert sorted(r.path for r in versions.read("chunks", versions.current()).collect()) == ["1", "3"]


def test_embedding_goes_on_where_it_stopped(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "id long, text string")
    store = vectors.VectorStore(spark, workspace(spark, "vectors"), "id")
    real, done = vectors.embed, []

    def dies(rows, *args):
        if len(done) == 3:
            raise KeyboardInterrupt
        done.append(rows.count())
        return real(rows, *args)

    monkeypatch.setattr(vectors, "embed", dies)
    with pytest.raises(KeyboardInterrupt):
        store.refresh(chunks, "text", vectors.letter_embedder, ranges=8, partitions=2)
    monkeypatch.setattr(vectors, "embed", real)
    assert store.read().count() == sum(done)
    assert store.refresh(chunks, "text", vectors.letter_embedder, ranges=8, partitions=2) == {"kept": sum(done), "embedded": 200 - sum(done), "removed": 0}
    fewer = chunks.filter("id % 4 <> 0").unionByName(spark.createDataFrame([(500, "late")], "id long, text string"))
    assert store.refresh(fewer, "text", vectors.letter_embedder) == {"kept": 150, "embedded": 1, "removed": 50}
    assert store.refresh(chunks, "text", vectors.letter_embedder) == {"kept": 150, "embedded": 50, "removed": 1}
    plain = {r.id: list(r.embedding) for r in real(chunks, ["id"], "text", vectors.letter_embedder).collect()}
    assert {r.id: list(r.embedding) for r in store.read().collect()} == plain


def test_masked_without_a_join_on_frequent_values(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "" if i % 5 == 1 else f"name{i % 40}", f"code{i}") for i in range(300)],
                                 "id long, name string, code string")
    categories = {"name": "ФЛ", "code": "КОД"}
    for digits in (1, 2, 6):  # with one digit nearly all tokens collide
        dictionary = privacy.token_dictionary(privacy.column_values(rows, categories), "pepper", digits)
        token = {(r.category, r.value): r.token for r in dictionary.collect()}
        assert len(set(token.values())) == len(token)
        masked = privacy.mask_columns(rows, categories, dictionary, "pepper", digits)
        assert sorted(map(tuple, masked.collect())) == sorted(
            (r.id, token.get(("ФЛ", r.name), r.name), token[("КОД", r.code)]) for r in rows.collect())


def test_codes_with_many_taken_numbers(spark):
    rnd = random.Random(3)
    codes = ["a"] * 60 + ["b"] * 5 + [f"a_{rnd.randrange(2, 90)}" for _ in range(40)] + ["b_3", "b_2_2", "c_9"]
    rnd.shuffle(codes)
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code string")
    got = {r["id"]: r["unique_code"] for r in links.unique_slugs(df, "code", "id", F.floor(F.col("id") / 7)).collect()}
    bearers, seen = set(codes), {}
    for i, code in enumerate(codes):
        if code not in seen:
            seen[code] = 1
            assert got[i] == code
        else:
            seen[code] += 1
            while f"{code}_{seen[code]}" in bearers:
                seen[code] += 1
            assert got[i] == f"{code}_{seen[code]}"


def test_a_hundred_thousand_taken_numbers(spark):
    taken = spark.range(2, 100_002).select((F.col("id") + 10).alias("id"), F.concat(F.lit("a_"), F.col("id").cast("string")).alias("code"))
    rows = taken.unionByName(spark.range(4).select("id", F.lit("a").alias("code")))
    got = links.unique_slugs(rows, "code", "id", F.floor(F.col("id") / 1000)).filter("code = 'a'").orderBy("id").collect()
    assert [r["unique_code"] for r in got] == ["a", "a_100002", "a_100003", "a_100004"]
