"""Sets of stages, their figures, and the first words of a ranking."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wordmine import discover_v3, write_stages
from wordmine.operators import ranking
from wordmine.session import figures, materialize
from wordmine.sources import read_stages


def entries(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) if folder.exists() else []


def test_all_stages_or_none(spark, tmp_path):
    good = spark.range(5).withColumnRenamed("id", "n")
    bad = good.select(F.raise_error(F.lit("second stage")).cast("long").alias("n"))
    folder = tmp_path / "out"
    with pytest.raises(Exception, match="second stage"):
        write_stages({"one": good, "two": bad, "three": good}, str(folder))
    assert entries(folder) == []
    with pytest.raises(FileNotFoundError):
        read_stages(spark, str(folder))
    # The same job again, mended.
    write_stages({"one": good, "two": good.where("n > 2")}, str(folder) + "/")
    assert entries(folder) == ["one", "stages.txt", "two"]
    found = read_stages(spark, str(folder))
    assert list(found) == ["one", "two"] and found["two"].count() == 2
    with pytest.raises(FileExistsError):
        write_stages({"two": good}, str(folder))
    # A set that was being put in place when the driver was lost.
    half = tmp_path / "half"
    good.write.parquet(str(half / "one"))
    with pytest.raises(FileNotFoundError):
        read_stages(spark, str(half))
    with pytest.raises(FileExistsError):
        write_stages({"one": good, "two": good}, str(half))


def jobs(spark, group, work):
    """How many jobs some work runs."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_figures_need_no_job(spark, corpus, words):
    docs = corpus(*["abab, xyab abq", "ab xy zab, ab"] * 8)
    run = lambda: discover_v3(docs, words(), words("ab"), 3, 4)
    plain = jobs(spark, "plain", run)
    with figures() as stages:
        assert jobs(spark, "observed", run) == plain
    assert [s["stage"] for s in stages] == ["ngrams", "frequent", "features"]
    # 4 + 4 + 3 and 2 + 2 + 3 + 2 characters, eight times each.
    assert stages[0]["characters"] == 8 * 20 and stages[0]["rows"] > stages[1]["rows"] > stages[2]["rows"] > 0
    assert all(s["seconds"] > 0 for s in stages)


def test_figures_nest_and_end(spark):
    df = spark.range(7)
    with figures() as outer:
        with figures() as inner:
            materialize(df, stage="in", total=F.sum("id"))
        materialize(df)
        materialize(df.where("id > 100"), stage="none")
    materialize(df, stage="after")
    (one,), (none,) = inner, outer
    assert (one["stage"], one["rows"], one["total"]) == ("in", 7, 21)
    assert (none["stage"], none["rows"]) == ("none", 0)


def test_top(spark):
    rows = [(f"w{i:04d}", (i * 7919) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "word string, freq bigint").repartition(7)
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 40, 600):
        got = [tuple(r) for r in ranking.top(df, "freq", k).orderBy("rank").collect()]
        assert got == [(i, *r) for i, r in enumerate(expected[:k], 1)]
    assert ranking.top(df.limit(0), "freq", 5).count() == 0
    plan = ranking.top(df, "freq", 40)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
