import pytest
from pyspark.sql import functions as F

from strikeline import schemas
from strikeline.operators import logs, quality
from strikeline.plans import validation
from strikeline.sources import files, writers

AS_OF = "2024-01-10"


def _config(spark, **given):
    base = {
        "name": "IDX", "UPDATED_DATE_TIME": "2024-01-10 09:30:00", "MARKET_IS_OPEN_TODAY": "YES",
        "OPT_EXPIRY_DATE_STR": "11JAN2024",
    } | given
    schema = ", ".join(f"{c} string" for c in base)
    df = spark.createDataFrame([tuple(base.values())], schema)
    return df.withColumn("UPDATED_DATE_TIME", F.col("UPDATED_DATE_TIME").cast("timestamp_ntz"))


def _failed(df):
    return {r.check for r in df.where("NOT passed").collect()}


def test_config_checks(spark):
    assert _failed(quality.config_checks(_config(spark), AS_OF)) == set()
    stale = _config(spark, UPDATED_DATE_TIME="2024-01-10 09:07:00")
    assert _failed(quality.config_checks(stale, AS_OF)) == {"fresh"}
    skipped = quality.config_checks(stale, AS_OF, skip_freshness=True)
    assert _failed(skipped) == set()
    assert skipped.where("check = 'fresh'").first().severity == "WARNING"
    closed = _config(spark, MARKET_IS_OPEN_TODAY="NO")
    assert _failed(quality.config_checks(closed, AS_OF)) == {"market_open"}
    assert _failed(quality.config_checks(closed, AS_OF, skip_market=True)) == set()
    missing = _config(spark, OPT_EXPIRY_DATE_STR=None)
    assert _failed(quality.config_checks(missing, AS_OF)) == {"has_OPT_EXPIRY_DATE_STR"}


def _chain(spark, strikes):
    rows = [("IDX", f"{s}{side}", "x", s, "2024-01-11", side) for s in strikes for side in ("CE", "PE")]
    return spark.createDataFrame(
        rows, "name string, token string, symbol string, strike long, expiry string, ce_or_pe string"
    ).withColumn("expiry", F.col("expiry").cast("date"))


def test_ladder_and_promotion(spark, tmp_path):
    prices = spark.createDataFrame([("IDX", 44512.3)], "name string, price double")
    full = _chain(spark, range(43800, 45300, 100))
    assert quality.expected_ladder(prices).count() == 30
    assert quality.missing_strikes(full, prices).count() == 0
    holed = full.where("NOT (strike = 44000 AND ce_or_pe = 'CE')")
    assert [tuple(r) for r in quality.missing_strikes(holed, prices).collect()] == [
        ("IDX", "CE", 44000)
    ]
    assert _failed(quality.ladder_checks(holed, prices)) == {"ce_strikes"}
    no_price = spark.createDataFrame([("IDX", 0.0)], "name string, price double")
    assert _failed(quality.ladder_checks(full, no_price)) == {"ce_strikes", "pe_strikes"}

    for chain, kept in ((full, 30), (holed, 0)):
        checks = validation.checks(_config(spark), chain, prices, AS_OF)
        root = str(tmp_path / str(kept))
        done = validation.promote(chain, _config(spark), checks, root)
        assert done.chain.count() == kept and done.config.count() == (kept > 0)


def test_absent_inputs_fail(spark, tmp_path):
    """Underlyings without config, price or chain are named as failed and not promoted."""
    full = _chain(spark, range(43800, 45300, 100))
    prices = spark.createDataFrame([("IDX", 44512.3)], "name string, price double")
    nothing = prices.where("false")
    assert _failed(validation.checks(_config(spark), full, nothing, AS_OF)) == {
        "ce_strikes", "pe_strikes"
    }
    assert _failed(validation.checks(_config(spark), full.where("false"), prices, AS_OF)) == {
        "ce_strikes", "pe_strikes"
    }
    no_config = validation.checks(_config(spark).where("false"), full, prices, AS_OF)
    assert _failed(no_config) == {"has_config"}
    expected = spark.createDataFrame([("IDX",), ("OTHER",)], "name string")
    both = validation.checks(_config(spark), full, prices, AS_OF, names=expected)
    assert {r.scope for r in quality.verdict(both).where("not passed").collect()} == {"OTHER"}
    assert validation.promote(full, _config(spark), no_config, str(tmp_path)).chain.count() == 0


def _generation(spark, root, expiry, strikes):
    chain = _chain(spark, strikes).withColumn("expiry", F.lit(expiry).cast("date"))
    return validation.stage(chain, _config(spark, OPT_EXPIRY_DATE_STR=expiry), root)


def _in_force(spark, root):
    found = validation.published(spark, root)
    return found.config.first().OPT_EXPIRY_DATE_STR, {str(r.expiry) for r in found.chain.collect()}


@pytest.mark.parametrize("dies_at", ["json", "chain", "pointer"])
def test_publishing_that_dies_leaves_the_last_generation(spark, tmp_path, monkeypatch, dies_at):
    """Chain and config in force are always of one generation."""
    root, full = str(tmp_path), range(43800, 45300, 100)
    passes = lambda config, chain: config.select(F.col("name").alias("scope"), F.lit(True).alias("passed"))
    with pytest.raises(FileNotFoundError):
        validation.published(spark, root)
    validation.publish(spark, root, _generation(spark, root, "2024-01-11", full), passes)
    assert _in_force(spark, root) == ("2024-01-11", {"2024-01-11"})

    def dies(*_, **__):
        raise RuntimeError("killed")

    second = _generation(spark, root, "2024-01-18", full)
    where = {"json": (writers, "write_json"), "chain": (writers, "write_chain"),
             "pointer": (files, "create_whole")}[dies_at]
    with monkeypatch.context() as m:
        m.setattr(*where, dies)
        with pytest.raises(RuntimeError):
            validation.publish(spark, root, second, passes)
    assert _in_force(spark, root) == ("2024-01-11", {"2024-01-11"})

    third = _generation(spark, root, "2024-01-25", full)
    validation.publish(spark, root, third, passes)
    assert _in_force(spark, root) == ("2024-01-25", {"2024-01-25"})
    validation.prune(spark, root, keep=1, grace_seconds=0)
    assert files.names(spark, f"{root}/generations") == [third]
    assert _in_force(spark, root) == ("2024-01-25", {"2024-01-25"})


def test_required_inputs_read_no_column(spark, tmp_path):
    """An empty file of a side is as good as none, and only footers are read."""
    path = str(tmp_path / "chain")
    chain = _chain(spark, [44000])
    writers.write_chain(chain.where("ce_or_pe = 'CE'"), path, by=("name", "expiry", "ce_or_pe"))
    empty = chain.where("false").select("token", "symbol", "strike")
    expiry = chain.first().expiry
    empty.write.parquet(f"{path}/name=IDX/expiry={expiry}/ce_or_pe=PE")
    stored = spark.read.schema(schemas.OPTION_CHAIN).parquet(path)
    config = _config(spark, T_DATE=None, OPT_EXPIRY_DATE_STR=expiry.strftime("%d%b%Y").upper())
    checks = quality.required_inputs(config, stored)
    assert _failed(checks) == {"has_T_DATE", "pe_stored"}
    plan = stored.groupBy("name", "expiry", "ce_or_pe").count()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in plan


def test_missing_partitions(spark):
    chain = _chain(spark, [44000]).where("ce_or_pe = 'CE'")
    expected = chain.select("expiry").distinct().crossJoin(
        spark.createDataFrame([("CE",), ("PE",)], "ce_or_pe string")
    )
    assert [r.ce_or_pe for r in quality.missing_partitions(expected, chain).collect()] == ["PE"]


def test_log_history_splits_the_log(spark, tmp_path):
    issues = spark.createDataFrame(
        [("no call", "2024-01-09 10:00:00"), ("no put", "2024-01-10 10:00:00")],
        "msg string, at string",
    )
    rows = logs.log_rows(issues, "job", F.lit("ERROR"), F.col("msg"), F.col("at"))
    assert rows.schema.names == schemas.LOG.names
    logs.append_log(rows, str(tmp_path / "log"))
    stored = spark.read.schema(schemas.LOG).parquet(str(tmp_path / "log"))
    old = logs.to_history(stored, AS_OF, F.lit("2024-01-10 23:00:00"))
    assert [r.LOG_MESSAGE for r in old.collect()] == ["no call"]
    assert set(old.schema.names) == set(schemas.LOG_HISTORY.names)
    assert [r.LOG_MESSAGE for r in logs.still_current(stored, AS_OF).collect()] == ["no put"]
