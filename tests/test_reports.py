"""Cases of chart readings from files, and the report's bundle."""

import json

from quantspark.operators import vision
from quantspark.plans.configured import COMPARISON
from quantspark.plans.report import SECTIONS
from quantspark.sources import reports


def reading(ticker="A", bias="bullish", rsi=50.0, levels=(), timeframe="1D", confidence=0.8):
    return {"ticker": ticker, "bias": bias, "timeframe": timeframe, "indicators": {"rsi": {"value": rsi}, "extras": {"x": 1}}, "levels": [{"price": p, "kind": "support", "label": "l"} for p in levels], "confidence": {"overall": confidence}}


def test_cases_from_folders(spark, tmp_path):
    cases = {"good": (reading(levels=[100, 101, 50]), reading("a", rsi=58.0, levels=[100.5, 100.6, 80], timeframe="1d", confidence=0.6)), "worse": (reading(rsi=None, levels=[1]), reading("B", "bearish", rsi=20.0)), "none": (reading(), reading(confidence=None)), "extra": (reading(), reading(levels=[3]))}
    for name, (truth, pred) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "ground_truth.json").write_text("\n" + json.dumps(truth, indent=1))
        (tmp_path / name / "prediction.json").write_text(json.dumps(pred))
    for name, files in {"alone": {"ground_truth.json": json.dumps(reading())}, "broken": {"ground_truth.json": json.dumps(reading()), "prediction.json": "{oops"}, "list": {"ground_truth.json": "[1]", "prediction.json": json.dumps(reading())}, "other": {"notes.json": "{}"}}.items():
        (tmp_path / name).mkdir()
        for f, text in files.items():
            (tmp_path / name / f).write_text(text)
    read = vision.read_cases(spark, str(tmp_path))
    assert sorted(r.case for r in read.collect()) == ["broken", "extra", "good", "list", "none", "worse"]
    got = {r.case: r for r in vision.score_cases(read).collect()}
    assert sorted(got) == ["extra", "good", "none", "worse"]
    g = got["good"]
    assert (g.ticker_accuracy, g.bias_accuracy, g.rsi_abs_error, g.timeframe_match) == (1, 1, 8, 1) and abs(g.level_precision - 2 / 3) < 1e-12 and abs(g.level_recall - 2 / 3) < 1e-12 and abs(g.level_f1 - 2 / 3) < 1e-12
    assert tuple(got["worse"])[1:4] == (0, 0, None) and (got["worse"].level_precision, got["worse"].level_recall, got["worse"].level_f1) == (1, 0, 0)
    assert (got["none"].level_precision, got["none"].level_recall, got["none"].level_f1) == (1, 1, 1) and (got["extra"].level_precision, got["extra"].level_recall, got["extra"].level_f1) == (0, 1, 0)
    a = vision.aggregate_scores(vision.score_cases(read)).first()
    assert a.n == 4 and a.ticker_accuracy == 0.75 and abs(a.mean_rsi_abs_error - 8 / 3) < 1e-12 and abs(a.mean_pred_confidence - (0.6 + 0.8 + 0.8) / 3) < 1e-12
    (tmp_path / "lines").write_text("\n".join([json.dumps({"id": k, "truth": t, "pred": p}) for k, (t, p) in cases.items()] + ["", json.dumps({"truth": reading(), "pred": 7}), "{bad"]))
    lines = vision.score_cases(vision.read_case_lines(spark, f"{tmp_path}/lines"))
    assert sorted(map(tuple, lines.collect()), key=str) == sorted(map(tuple, got.values()), key=str)
    empty = vision.aggregate_scores(lines.where("false")).first()
    assert empty.n == 0 and empty.mean_level_f1 is None


def test_bundle(spark, tmp_path):
    sections = spark.createDataFrame([(t, i, s, f"text {i} of {t}") for t in ("A", "B") for i, s in reversed(list(enumerate(SECTIONS)))], "ticker string, place int, section string, text string")
    table = spark.createDataFrame([("A", "gbm", 1.5, None), ("A", "kou|x", 2.25, 3)], "ticker string, model string, sharpe double, disagreement_rank int")
    text = {r.ticker: r.markdown for r in reports.rendered(sections, table, ["model", "sharpe", "disagreement_rank"]).collect()}
    assert [line[3:] for line in text["B"].splitlines() if line.startswith("## ")] == list(SECTIONS)
    assert text["A"].endswith("## Models\n\n| model | sharpe | disagreement_rank |\n|---|---|---|\n| gbm | 1.5000 |  |\n| kou\\|x | 2.2500 | 3 |\n")
    reports.write_bundle(sections, table, f"{tmp_path}/r", ["model", "sharpe", "disagreement_rank"])
    assert next((tmp_path / "r" / "md" / "ticker=B").glob("part-*")).read_text().strip() == text["B"].strip()
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/csv").where("ticker = 'A'").count() == 2 and spark.read.json(f"{tmp_path}/r/json").count() == 2


def test_report_of_every_ticker(spark):
    from quantspark import registry

    rows = registry.QUERIES["investment_report"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 5 * len(SECTIONS) and all(r.text and "null" not in r.text.lower() for r in rows) and len(COMPARISON) == 22


def test_readings_as_signals(spark):
    from quantspark.operators.vision import READING, level_key, signals_of
    from pyspark.sql import functions as F

    rows = [("a", ("x", "1D", "bullish", ((55.0,),), [(100.0, "support", 0.4), (0.00123456789, "support", 0.8), (1234567.0, "r", None), (3.0, "r", 0.0)], (None,))), ("b", ("Y", None, None, None, None, (0.3,)))]
    got = {r.case: r for r in signals_of(spark.createDataFrame(rows, f"case string, reading struct<{READING.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>")).collect()}
    assert (got["a"].ticker, got["a"].symbol, got["a"].trend, got["a"].rsi, got["a"].tf) == ("X", "X", "bullish", 55.0, "1D") and abs(got["a"].confidence_overall - 0.6) < 1e-12
    assert got["a"].levels == ["100", "0.00123457", "1234570", "3"] and (got["b"].confidence_overall, got["b"].levels, got["b"].momentum) == (0.3, None, None)
    x = spark.createDataFrame([(v,) for v in (0.0, 12.5, -3.25, 99999.95)], "v double").select(level_key(F.col("v"))).collect()
    assert [r[0] for r in x] == ["0", "12.5", "-3.25", "100000"]


def test_small_tables_as_text(spark, tmp_path):
    table = spark.createDataFrame([("b", 2.5, None), ("a|c", 1 / 3, 7)], "name string, x double, n int")
    assert reports.markdown_text("T", table, ["x"]).first().value == "# T\n\n| name | x | n |\n|---|---|---|\n| a\\|c | 0.333333 | 7 |\n| b | 2.50000 |  |\n"
    assert reports.markdown_text("T", table.where("false"), ["x"]).first().value.startswith("# T")
    reports.write_outcomes(table, f"{tmp_path}/o")
    assert spark.read.option("header", True).csv(f"{tmp_path}/o").count() == 2
