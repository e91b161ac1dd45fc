"""Every query with SQL against DuckDB over the smallest tables, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from lexmill.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, registry.queries()[name], registry.oracle_sql().get(name)) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["ord", "digest"]


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sinks(spark, tmp_path):
    from lexmill.operators import bpe, clean
    from lexmill.plans.common import table, texts
    from lexmill.sources import readers, sinks

    sinks.write_manifest(clean.manifest(texts(spark, SF)), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first().raw_count > 0
    sinks.write_texts(table(spark, SF, "corpus").where("variant = 'lossless'").select("lang", "text"), f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").select("lang").distinct().count() == 4
    e = bpe.Encoder([*bpe.BYTES, "a", "b", "ab"], [("a", "b")])
    sinks.write_tokenizer(spark, e, f"{tmp_path}/k")
    back = sinks.read_tokenizer(spark, f"{tmp_path}/k")
    assert back.tokens == e.tokens and back.rank == e.rank
    sinks.write_vocabulary(bpe.vocabulary(spark, e), f"{tmp_path}/v")
    assert spark.read.text(f"{tmp_path}/v").count() == 259
    (tmp_path / "a.txt").write_bytes(b"x\r\ny")
    assert readers.whole_texts(spark, f"{tmp_path}/a.txt").first().text == "x\ny"
    (tmp_path / "m.json").write_text('[{"lang": "en",\n "chars": 3}, {"lang": "hi", "chars": null}]')
    assert sorted(map(tuple, readers.json_files(spark, f"{tmp_path}/m.json", "lang string, chars long").collect()), key=str) == [("en", 3), ("hi", None)]
    sinks.write_table(clean.cleaned(texts(spark, SF)), f"{tmp_path}/c")
    kept = spark.read.parquet(f"{tmp_path}/c")
    assert kept.columns == ["text"] and kept.count() == clean.cleaned(texts(spark, SF)).count()


def test_tables_shared_by_all_executors(spark):
    from types import SimpleNamespace

    from lexmill import session

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(cluster)
    step = session.materialise(spark.range(5))
    assert step.count() == 5
    session.release(step)
    p, files = session._folder(spark, step._step)
    assert not files.exists(p)


def test_streams_of_several_batches(spark, tmp_path):
    from lexmill.streaming import cleaning

    # one file a batch: groups grow over batches, and the last windows are there though no watermark closes them
    for k, day in enumerate(("01", "02", "03")):
        rows = [(f"2024-01-{day} 10:0{m}:00", t, 1.0) for m in range(3) for t in ("a", "b")] + [(f"2024-01-0{max(1, k)} 10:30:00", "a", 5.0)]
        spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = {(str(r.start), r.event_type): (r.n, r.total) for r in cleaning.upsert_once(cleaning.hourly(events, "10 days"), "t", ["start", "event_type"]).collect()}
    assert len(got) == 6 and sum(n for n, _ in got.values()) == 21 and sum(x for _, x in got.values()) == 33.0
