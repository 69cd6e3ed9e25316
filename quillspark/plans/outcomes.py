"""Queries over arm outcomes; arms and replicates are derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes as O

_ARMS = {"none": (7, 53), "case": (11, 62), "strategy": (13, 58), "both": (17, 66)}
REPLICATES = 3


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, arm, replicate, correct, grp, cust, tokens): a fixed arithmetic rule stands in for a model's answers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("cust"))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(r).alias("replicate")) for a, (p, t) in _ARMS.items() for r in range(REPLICATES))))
    x = o.withColumn("e", each).select("sample_id", "grp", "cust", "e.*")
    return x.select("sample_id", "arm", "replicate", (((F.col("sample_id") * F.col("p")) + (F.col("sample_id") % 5 + 31) * F.col("replicate")) % 101 < F.col("t")).alias("correct"), "grp", "cust", (F.col("sample_id") % 37 + F.col("p") * 10).alias("tokens"))


_VALUES = ", ".join(f"('{a}', {p}, {t})" for a, (p, t) in _ARMS.items())
ARMS_SQL = f"""arms AS (SELECT o_orderkey AS sample_id, a.arm, r.replicate, ((o_orderkey * a.p) + (o_orderkey % 5 + 31) * r.replicate) % 101 < a.t AS correct, o_orderpriority AS grp, o_custkey AS cust, o_orderkey % 37 + a.p * 10 AS tokens
FROM orders, (VALUES {_VALUES}) a(arm, p, t), (VALUES (0), (1), (2)) r(replicate)),
wide AS (SELECT sample_id, replicate, {", ".join(f"bool_or(correct) FILTER (arm = '{a}') AS {'both_' if a == 'both' else a + '_'}" for a in _ARMS)} FROM arms GROUP BY ALL)"""
_R = "round({}, 9)"


def _q(f, *cols: str):
    """A query: the operator over the arms table, doubles rounded to nine places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(arms(spark, sf_dir))
        return out.select(*(F.round(F.col(c), 9).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "bigint") else F.col(c) for c, k in out.dtypes))

    return run


def _sql(body: str) -> str:
    return f"WITH {ARMS_SQL}{body}" if body.startswith(",") else f"WITH {ARMS_SQL} {body}"


def _front(a: DataFrame) -> DataFrame:
    return O.pareto(a.select("sample_id", "arm", "replicate", "correct"), a.where("replicate = 0").select("sample_id", "arm", "tokens"))


def _policy(a: DataFrame) -> DataFrame:
    choice = F.when(F.col("sample_id") % 7 == 0, "case").when(F.col("sample_id") % 7 == 1, "strategy").otherwise("both")
    return O.policy(a, a.where("replicate = 0 and arm = 'both'").select("sample_id", choice.alias("arm")))


QUERIES = {
    "d2_arm_accuracy": _q(lambda a: O.accuracy(a, "grp")),
    "d3_fixed_oracle_gap": _q(O.fixed_and_oracle),
    "d4_expected_metrics": _q(O.expected),
    "d5_contingency": _q(lambda a: O.contingency(a, "case", "strategy")),
    "d6_interference": _q(O.interference),
    "d7_patterns": _q(O.patterns),
    "d8_d9_exclusive_rescues": _q(O.exclusive),
    "d10_transitions": _q(O.transitions),
    "c11_agreement": _q(O.agreement),
    "d26_flip_rates": _q(O.flips),
    "d27_preference_stability": _q(lambda a: O.stability(a, "case", "both")),
    "d23_marginal_utility": _q(O.marginal),
    "d22_support_audit": _q(O.support),
    "d28_preference_transfer": _q(O.transfer),
    "d24_policy_evaluation": _q(_policy),
    "d39_cost_pareto": _q(_front),
    "d40_dose_response": _q(lambda a: O.monotone(a.groupBy((F.col("sample_id") % 4).alias("level")).agg(F.avg(O.hit()).alias("v")), "level", "v")),
    "d38_runtime_summary": _q(lambda a: O.same_runtime(a, "arm", "grp")),
}
_SIDE = "SELECT sample_id, replicate, both_, {a}_ AS r, '{a}' AS arm FROM wide"
_OTHERS = " UNION ALL ".join(_SIDE.format(a=a) for a in ("none", "case", "strategy"))
_BASE = " UNION ALL ".join(f"SELECT none_ AS b, {'both_' if a == 'both' else a + '_'} AS r, '{a}' AS arm FROM wide" for a in ("case", "strategy", "both"))
_MARG = f"m AS (SELECT sample_id, arm, avg((r AND NOT both_)::INT) AS gain, avg((NOT r AND both_)::INT) AS harm, avg(r::INT) - avg(both_::INT) AS delta, count(*) FILTER (r AND NOT both_) AS events FROM ({_OTHERS}) GROUP BY ALL)"
_PAT = "concat_ws('+', " + ", ".join(f"CASE WHEN {a}_ THEN '{a}' END" for a in _ARMS) + ")"
ORACLES = {
    "d2_arm_accuracy": _sql("SELECT arm, grp, count(*) AS n, round(avg(correct::INT), 9) AS accuracy FROM arms GROUP BY ALL"),
    "d3_fixed_oracle_gap": _sql("""SELECT replicate::BIGINT AS replicate, CASE WHEN n = b THEN 'none' WHEN c = b THEN 'case' WHEN s = b THEN 'strategy' ELSE 'both' END AS best_arm, round(b, 9) AS best_fixed, round(o, 9) AS oracle, round(o - b, 9) AS gap
FROM (SELECT *, greatest(n, c, s, x) AS b FROM (SELECT replicate, avg(none_::INT) AS n, avg(case_::INT) AS c, avg(strategy_::INT) AS s, avg(both_::INT) AS x, avg((none_ OR case_ OR strategy_ OR both_)::INT) AS o FROM wide GROUP BY ALL))"""),
    "d4_expected_metrics": _sql(""", p AS (SELECT sample_id, arm, avg(correct::INT) AS p FROM arms GROUP BY ALL) SELECT round(f, 9) AS best_fixed, round(o, 9) AS oracle, round(o - f, 9) AS gap FROM (SELECT max(a) AS f FROM (SELECT arm, avg(p) AS a FROM p GROUP BY arm)), (SELECT avg(m) AS o FROM (SELECT sample_id, max(p) AS m FROM p GROUP BY sample_id))"""),
    "d5_contingency": _sql("SELECT replicate::BIGINT AS replicate, count(*) FILTER (case_ AND strategy_) AS both_right, count(*) FILTER (case_ AND NOT strategy_) AS only_a, count(*) FILTER (NOT case_ AND strategy_) AS only_b, count(*) FILTER (NOT case_ AND NOT strategy_) AS neither FROM wide GROUP BY ALL"),
    "d6_interference": _sql("SELECT replicate::BIGINT AS replicate, count(*) FILTER (NOT both_ AND (case_ OR strategy_)) AS both_worse, count(*) FILTER (both_ AND NOT case_ AND NOT strategy_) AS both_better, count(*) FILTER (both_ = (case_ OR strategy_)) AS both_same FROM wide GROUP BY ALL"),
    "d7_patterns": _sql(f"SELECT replicate::BIGINT AS replicate, CASE WHEN {_PAT} = '' THEN '(none right)' ELSE {_PAT} END AS pattern, count(*) AS n FROM wide GROUP BY ALL"),
    "d8_d9_exclusive_rescues": _sql(f"SELECT replicate::BIGINT AS replicate, {_PAT} AS arm, count(*) AS rescues, min(sample_id) AS first_id FROM wide WHERE none_::INT + case_::INT + strategy_::INT + both_::INT = 1 GROUP BY ALL"),
    "d10_transitions": _sql(f"SELECT arm, CASE WHEN b AND r THEN 'both_right' WHEN NOT b AND NOT r THEN 'both_wrong' WHEN r THEN 'rescue' ELSE 'harm' END AS transition, count(*) AS n FROM ({_BASE}) GROUP BY ALL"),
    "c11_agreement": _sql("SELECT a.arm, a.replicate::BIGINT AS rep_a, b.replicate::BIGINT AS rep_b, round(avg((a.correct = b.correct)::INT), 9) AS agreement FROM arms a JOIN arms b ON a.sample_id = b.sample_id AND a.arm = b.arm AND a.replicate < b.replicate GROUP BY ALL"),
    "d26_flip_rates": _sql("SELECT arm, count(*) AS n, round(avg(f::INT), 9) AS flip_rate FROM (SELECT arm, sample_id, min(correct) <> max(correct) AS f FROM arms GROUP BY ALL) GROUP BY arm"),
    "d27_preference_stability": _sql("SELECT wins, count(*) AS samples FROM (SELECT sample_id, count(*) FILTER (case_ AND NOT both_) AS wins FROM wide GROUP BY ALL) GROUP BY wins"),
    "d23_marginal_utility": _sql(f", {_MARG} SELECT sample_id, arm, round(gain, 9) AS gain, round(harm, 9) AS harm, round(delta, 9) AS delta, events, round(gain - harm, 9) AS net FROM m"),
    "d22_support_audit": _sql(f", {_MARG} SELECT arm, count(*) FILTER (events >= 1) AS at_least_1, count(*) FILTER (events >= 2) AS at_least_2, count(*) FILTER (events >= 3) AS at_least_3 FROM m GROUP BY arm"),
    "d28_preference_transfer": _sql(""", k AS (SELECT f.fold, a.* FROM arms a, (VALUES (0), (1), (2)) f(fold) WHERE a.replicate <> f.fold), s AS (SELECT fold, sample_id, arm, avg(correct::INT) AS score FROM k GROUP BY ALL), o AS (SELECT fold, arm, avg(correct::INT) AS prior FROM k GROUP BY ALL),
pick AS (SELECT fold, sample_id, arm FROM s JOIN o USING (fold, arm) QUALIFY row_number() OVER (PARTITION BY fold, sample_id ORDER BY score DESC, prior DESC, arm) = 1)
SELECT a.replicate::BIGINT AS replicate, count(*) AS n, round(avg(a.correct::INT), 9) AS transfer_accuracy FROM pick p JOIN arms a ON a.replicate = p.fold AND a.sample_id = p.sample_id AND a.arm = p.arm GROUP BY ALL"""),
    "d24_policy_evaluation": _sql(""", c AS (SELECT *, sample_id % 7 < 2 AS dev, CASE sample_id % 7 WHEN 0 THEN case_ WHEN 1 THEN strategy_ ELSE both_ END AS got FROM wide), g AS (SELECT replicate, avg(got::INT) AS acc, avg(both_::INT) AS b, avg((none_ OR case_ OR strategy_ OR both_)::INT) AS o, avg(dev::INT) AS coverage, count(*) FILTER (dev AND got AND NOT both_) AS ben, count(*) FILTER (dev AND NOT got AND both_) AS harm, count(*) FILTER (dev) AS d FROM c GROUP BY ALL)
SELECT replicate::BIGINT AS replicate, round(acc, 9) AS accuracy, round(acc - b, 9) AS gain, round(coalesce((acc - b) / nullif(o - b, 0), 0), 9) AS recovery, round(coverage, 9) AS coverage, round(coalesce(ben / nullif(d, 0), 0), 9) AS "precision", round(coalesce(harm / nullif(d, 0), 0), 9) AS harmful_rate FROM g"""),
    "d39_cost_pareto": _sql(", g AS (SELECT arm, avg(tokens) AS t, avg(correct::INT) AS a FROM arms GROUP BY arm) SELECT arm, round(t, 9) AS tokens, round(a, 9) AS accuracy, NOT EXISTS (SELECT 1 FROM g h WHERE h.arm <> g.arm AND h.t <= g.t AND h.a >= g.a) AS on_front FROM g"),
    "d40_dose_response": _sql(", l AS (SELECT sample_id % 4 AS level, avg(correct::INT) AS v FROM arms GROUP BY ALL), b AS (SELECT v, lag(v) OVER (ORDER BY level) AS p FROM l) SELECT coalesce(bool_and(v <= p), true) AS never_rises, count(*) AS levels FROM b"),
    "d38_runtime_summary": _sql("SELECT list_sort(list(DISTINCT arm)) AS arm, list_sort(list(DISTINCT grp)) AS grp FROM arms"),
}
