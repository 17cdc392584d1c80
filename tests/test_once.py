"""Studies whose rows are evaluated once for all that is made of them, against what two evaluations give."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from ridgeline.functions.columns import finite
from ridgeline.operators import bars as B
from ridgeline.plans import evaluate, factors, studies

ROW = "day date, exit_day date, vt_symbol string, era string, intent_return double, worst_case_return double, entry_fill boolean, unclosed_at_horizon boolean, f_a double"
SF = "/root/testdata/sf0.01"


def scored(spark):
    first = date(2024, 1, 1)
    # The scores of the second day are all missing: it is a cross-section all the same.
    rows = [(first + timedelta(d), first + timedelta(d + 2), f"S{k}", "x", 0.1 * k, 0.1 * k, True, False, None if d == 1 else float(k)) for d in range(3) for k in range(4)]
    return spark.createDataFrame(rows, ROW)


def test_figures_have_the_size_of_every_cross_section(spark):
    figures = evaluate.top_figures(scored(spark), top=2)
    got = sorted((r.day.day, r.rows) for r in evaluate.cross_sections(figures).collect())
    assert got == [(1, 4), (2, 4), (3, 4)]
    assert sorted(r.day.day for r in evaluate.kept_days(figures, 1).collect()) == [1, 3] and evaluate.kept_days(figures, 1).where("factor IS NULL").count() == 0
    # Before, a panel of its own was worked out for the rows of a day.
    text = evaluate.held_figures(scored(spark), top=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in text


def test_crossing_rows_are_those_with_a_score(spark):
    """Before, rows without a finite score of the factor were counted too, which its SQL leaves out, and a second panel was worked out for the counts."""
    study = factors.STUDIES["stock"]
    frame = studies.keep_all_frame(spark, SF).withColumn("sd40", F.when(~F.col("vt_symbol").endswith("3"), F.col("sd40"))).checkpoint()
    eras = evaluate.by_era(frame, studies.ERAS, clip_exit=False)
    ends = F.create_map(*[F.lit(x) for name, _, end in studies.ERAS for x in (name, end)])
    crosses = F.col("exit_day") > F.element_at(ends, F.col("era")).cast("date")
    wanted = eras.groupBy("era").agg(*[F.count_if(crosses & finite(F.expr(x).cast("double"))).alias(n) for n, x in study.items()]).collect()
    got = {(r.factor, r.era): r.crossing_rows for r in studies.boundary(frame, "stock").collect()}
    assert got == {(n, r.era): r[n] for r in wanted for n in study if (n, r.era) in got} and len(got) > len(study)
    assert len({n for (_, era), n in got.items() if era == "train"}) > 1


def test_the_transfer_asks_for_the_features_of_its_symbols_alone(spark):
    bars = B.bar_table(spark, SF)
    got = studies.labelled_panel(bars, symbols=studies.COHORT)
    wanted = studies.labelled_panel(bars).where(studies.COHORT)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and got.count() > 50
    scored, _ = studies.transfer_rows(spark, SF, "ribbon_joint_widening", 1, studies.TRANSFER_PERIODS)
    text = scored._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [k for k, line in enumerate(text) if "% 3" in line]
    # Before, features of all symbols were made and those of two thirds dropped above the windows.
    assert depth and max(depth) > max(k for k, line in enumerate(text) if "Window [" in line and "vt_symbol" in line)
