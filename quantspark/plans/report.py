"""The investment report: sections of text by ticker, assembled from the comparison of models, stress runs and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Dialect
from ..registry import ORACLES, QUERIES, query
from ..sources.scratch import stored
from . import configured, decisions, statistics  # noqa: F401

# The sections' names, in order.
SECTIONS = (
    "Bottom Line", "What the Simulation Says", "Best Case", "Base Case", "Bad Case", "Severe Stress Case", "Biggest Risks", "What Could Make This Wrong", "Position Sizing Warning", "Suggested Next Questions Before Investing",
)
_PARTS = {"comp": "comparison_table", "stress": "stress_suite", "conf": "model_confidence"}


def _body(d: Dialect) -> str:
    """Relations that end in ``sections(ticker, place, section, text)``, from ``comp``, ``stress`` and ``conf``."""
    pct, money = lambda x: f"{d.fixed(f'100 * ({x})', 1)}, '%'", lambda x: d.fixed(x, 2)
    label = "CASE WHEN profit >= 0.55E0 AND loss20 <= 0.18E0 THEN 'favorable but risky' WHEN profit < 0.45E0 OR loss20 > 0.315E0 THEN 'unfavorable' ELSE 'neutral or uncertain' END"
    texts = (
        f"concat('The view is ', {label}, '. The middle of nine models puts the chance of a profit at ', {pct('profit')}, ' and the expected value at ', {money('expected')}, ' for 100.00 invested. Confidence in these models is ', lower(confidence), '.')",
        f"concat('Half of the models expect more than ', {money('expected')}, ', half less; their middle ending value is ', {money('median')}, '. A loss occurs with ', {pct('1 - profit')}, ', one beyond a fifth with ', {pct('loss20')}, '.')",
        f"concat('One path in twenty ends above ', {money('high')}, ' in the model that is most hopeful there.')",
        f"concat('The middle path ends near ', {money('median')}, '.')",
        f"concat('One path in twenty ends below ', {money('low')}, ' in the model that is most careful there.')",
        f"concat('Of seven stressed runs, ', worst, ' is worst: the expected value falls to ', {money('worst_value')}, ' and a loss beyond a fifth has a chance of ', {pct('worst_loss')}, '.')",
        f"concat('At the 99 % level ', conservative, ' loses most: ', {money('var99')}, ', and ', {money('es99')}, ' on average beyond it. Ruin, a fall by half, has a chance of up to ', {pct('ruin')}, '.')",
        "concat(CASE WHEN coalesce(warnings, '') = '' THEN 'No warning was raised' ELSE concat('Warnings: ', warnings) END, '. ', outlier, ' differs most from the other models.')",
        f"concat('A position whose loss at the 99 % level is one hundredth of an account takes ', {pct('least(1E0, 1E0 / greatest(var99, 1E-9))')}, ' of it at most.')",
        "concat('Does the drift of the history, ', " + d.fixed("100 * mu", 1) + ", '% a year over ', CAST(days AS VARCHAR(20)), ' days, hold from here? What would change the volatility of ', " + d.fixed("100 * sigma", 1) + ", '%?')",
    )
    if d.name == "spark":
        texts = tuple(t.replace("AS VARCHAR(20)", "AS STRING") for t in texts)
    text = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    names = " UNION ALL ".join(f"SELECT {i} AS place, '{s}' AS section" for i, s in enumerate(SECTIONS))
    q = lambda c, p: d.quantile(c, p)
    return f"""mid AS (SELECT ticker, {q("expected_ending_value", 0.5)} AS expected, {q("median_ending_value", 0.5)} AS median, {q("prob_profit", 0.5)} AS profit, {q("prob_loss_20", 0.5)} AS loss20, max(percentile_95) AS high, min(percentile_5) AS low, max(prob_ruin) AS ruin,
  max(CASE WHEN disagreement_rank = 1 THEN model END) AS outlier, max(CASE WHEN most_conservative THEN model END) AS conservative, max(CASE WHEN most_conservative THEN var_99 END) AS var99, max(CASE WHEN most_conservative THEN es_99 END) AS es99 FROM comp GROUP BY ticker),
hard AS (SELECT ticker, min(scenario) AS worst, min(expected_value) AS worst_value, max(prob_loss_20) AS worst_loss FROM stress WHERE worst GROUP BY ticker),
al AS (SELECT m.*, h.worst, h.worst_value, h.worst_loss, c.confidence, c.warnings, c.mu, c.sigma, c.n AS days FROM mid m JOIN hard h ON h.ticker = m.ticker JOIN conf c ON c.ticker = m.ticker),
sections AS (SELECT ticker, place, section, CASE place {text} END AS text FROM al CROSS JOIN ({names}) s)"""


_OUT = "SELECT ticker, CAST(place AS INT) AS place, section, text FROM sections"


@query(f"WITH RECURSIVE {', '.join(f'{k} AS ({ORACLES[v]})' for k, v in _PARTS.items())}, {_body(DUCK)} {_OUT}")
def investment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sections of text for every ticker, made by expressions over three relations; nothing is collected."""
    parts = {k: stored(QUERIES[v](spark, sf_dir), k) for k, v in _PARTS.items()}
    return spark.sql(f"WITH {', '.join(f'{k} AS (SELECT * FROM {{{k}}})' for k in parts)}, {_body(SPARK)} {_OUT}", **parts)
