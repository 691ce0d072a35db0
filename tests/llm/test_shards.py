import random

import pytest

from logloom.llm import shards as S


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.range(1).selectExpr("id as doc_id", "cast(id as string) as text").schema
    return S.ShardTable(spark, str(tmp_path / "t"), schema, target_bytes=40_000, fanout=3)


def rows(spark, a, b):
    return spark.range(a, b).selectExpr("id as doc_id", "repeat(sha(cast(id as string)), 3) as text").repartition(3)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_append_compact_versions_and_vacuum(spark, table, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BYTES", 4_000)
    assert table.version() == 0 and table.read().count() == 0 and table.compact() == 0
    for i in range(7):
        table.append(rows(spark, 100 * i, 100 * i + 100))
        table.compact()
    assert ids(table.read()) == list(range(700))
    tiers = [r.tier(3) for r in table.runs()]
    assert all(tiers.count(t) < 3 for t in tiers) and len(table.runs()) < 7
    assert sum(r.rows for r in table.runs()) == 700
    assert ids(table.read(2)) == list(range(200))
    assert table.vacuum() > 0
    assert ids(table.read()) == list(range(700))


def test_arrivals_in_one_pass_and_target_sized_files(spark, table, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BYTES", 1_000_000)
    new = table.append(rows(spark, 0, 2000), S.F.expr("doc_id % 5"))
    assert len(new) == 5 and sum(r.rows for r in new) == 2000 and sum(r.files for r in new) == 15
    assert table.compact() == 1
    (run,) = table.runs()
    assert run.rows == 2000 and run.files == max(1, round(sum(r.bytes for r in new) / 40_000))
    assert ids(table.read()) == list(range(2000))


def test_commits_are_atomic(spark, table):
    table.append(rows(spark, 0, 10))
    seen = table.version()
    table.commit(seen, table.runs(), {})
    with pytest.raises(S.Conflict):
        table.commit(seen, [], {})
    assert table.version() == seen + 1 and ids(table.read()) == list(range(10))


def test_append_of_another_writer_survives_a_merge(spark, table, monkeypatch):
    monkeypatch.setattr(S, "LEAST_BYTES", 10_000_000)
    for i in range(3):
        table.append(rows(spark, 10 * i, 10 * i + 10))
    measured, late = table._measured, []

    def slow(base, inner):
        if not late:
            late.append(1)
            other = S.ShardTable(spark, table.path, table.schema, fanout=99)
            other.append(rows(spark, 90, 95))
        return measured(base, inner)

    monkeypatch.setattr(table, "_measured", slow)
    table.compact()
    assert ids(table.read()) == [*range(30), *range(90, 95)]


def test_nulls_repeats_empty_arrivals_and_extra_columns(spark, table):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id bigint, text string, _arrival int")
    table.append(odd)
    assert table.append(odd.limit(0)) == []
    assert sorted(map(str, table.read().collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))


def test_a_repeated_append_adds_nothing(spark, table):
    for _ in range(2):
        table.append(rows(spark, 0, 10), source="crawl", sequence=1)
        table.append(rows(spark, 10, 20), source="other", sequence=7)
    table.compact()
    assert table.append(rows(spark, 0, 10), source="crawl", sequence=1) == []
    table.append(rows(spark, 20, 30), source="crawl", sequence=2)
    assert ids(table.read()) == list(range(30)) and table.manifest()[1] == {"crawl": 2, "other": 7}


def test_columns_of_the_names_used_inside_and_very_long_texts(spark, tmp_path):
    odd = spark.createDataFrame([(1, "x" * 3_000_000, 5, "m"), (1, "x" * 3_000_000, 5, "m"), (2, None, None, "")], "doc_id bigint, text string, _arrival int, _metadata string")
    odd = odd.withColumn("_lot", S.F.lit("kept"))
    t = S.ShardTable(spark, str(tmp_path / "odd"), odd.schema)
    assert len(t.append(odd, S.F.col("doc_id"))) == 2
    t.compact()
    got = t.read()
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))


def test_query_keeps_a_column_called_lot(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 2, f"own {i}", i) for i in range(40)] + [(None, None, None, None, None, None, None)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint, _lot string, _arrival int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert S.query(spark, str(tmp_path)).count() == 42
