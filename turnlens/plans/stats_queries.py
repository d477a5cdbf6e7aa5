"""Where turns fail: by depth, by type, by what went before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlens.functions import stats, vocab
from turnlens.plans import views as v
from turnlens.plans.oracle import in_, mcnemar, r6, sql, two_z, wilson

_ok = lambda c="outcome": F.coalesce((F.col(c) == "correct").cast("long"), F.lit(0).cast("long"))


def _rates(k: Column, n: Column) -> list[Column]:
    low, high = stats.wilson(k, n)
    return [F.round(stats.ratio(k, n), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high")]


def _contrast(df: DataFrame, one: str, two: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts of two groups, their difference, z and p."""
    c = [F.col(f"{g}_{x}") for g in (one, two) for x in ("k", "n")]
    z, p = stats.two_proportion_z(*c)
    delta = F.coalesce(stats.ratio(c[0], c[1]), F.lit(0.0)) - F.coalesce(stats.ratio(c[2], c[3]), F.lit(0.0))
    return df.select(*keys, *c, F.round(delta, 6).alias("delta"), F.round(z, 6).alias("z"), F.round(p, 6).alias("p"))


def _counts(**groups: Column) -> list[Column]:
    """k and n of each named condition."""
    out = []
    for name, cond in groups.items():
        out += [F.coalesce(F.sum(F.when(cond, F.col("ok"))), F.lit(0)).alias(f"{name}_k"), F.count(F.when(cond, 1)).alias(f"{name}_n")]
    return out


def outcome_profile(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.count_if(F.col("outcome").isin("wrong", "hallucinated"))
    return v.log(spark, sf).groupBy("rag", "dataset").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "hallucinated", "abstained")), F.round(bad / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("failure_rate"))


def position_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy at each depth, and whether the depth counts as early or late."""
    by = v.log(spark, sf).filter(~F.col("query_type").isin(*vocab.EXCLUDED_TYPES)).groupBy("turn_id").agg(F.sum(_ok()).alias("k"), F.count(F.lit(1)).alias("n"))
    # one row a depth is left: ranking them needs no partition
    ranked = by.withColumn("d", F.row_number().over(Window.orderBy("turn_id"))).crossJoin(F.broadcast(by.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 3)).alias("cut"), F.count(F.lit(1)).alias("m"))))
    return ranked.select("turn_id", "k", "n", *_rates(F.col("k"), F.col("n")), (F.col("d") <= F.col("cut")).alias("early"), (F.col("d") > F.col("m") - F.col("cut")).alias("late"))


def position_contrast(spark: SparkSession, sf: str) -> DataFrame:
    sums = lambda g: [F.sum(F.when(F.col(g), F.col(x)).otherwise(0)).alias(f"{g}_{x}") for x in ("k", "n")]
    return _contrast(position_effect(spark, sf).agg(*sums("early"), *sums("late")), "early", "late")


def type_effect(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.log(spark, sf).groupBy("query_type").agg(F.sum(_ok()).alias("k"), F.count(F.lit(1)).alias("n"))
    group = F.when(F.col("query_type").isin(*vocab.HISTORY_DEPENDENT), "history").when(F.col("query_type").isin(*vocab.SELF_CONTAINED), "self").otherwise("none")
    return rows.select("query_type", group.alias("type_group"), "k", "n", *_rates(F.col("k"), F.col("n")))


def _type_groups(rows: DataFrame) -> DataFrame:
    own, dep = F.col("query_type").isin(*vocab.SELF_CONTAINED), F.col("query_type").isin(*vocab.HISTORY_DEPENDENT)
    return rows.withColumn("ok", _ok()).agg(*_counts(dep=dep, own=own))


def type_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """History-dependent against self-contained types; z is of the first against the second."""
    return _signed(_type_groups(v.log(spark, sf)))


def _signed(df: DataFrame) -> DataFrame:
    return _contrast(df, "dep", "own").withColumn("delta", -F.col("delta"))


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy("turn_id")
    rows = v.log(spark, sf).withColumn("prev", F.lag("outcome").over(w))
    return rows.filter(F.col("prev").isNotNull() & ~F.col("query_type").isin(*vocab.EXCLUDED_TYPES))


def type_effect_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _signed(_type_groups(_paired(spark, sf).filter("prev = 'correct'")))


def propagation(spark: SparkSession, sf: str) -> DataFrame:
    """After a correct turn against after a failed one, raw and pooled within question types."""
    good = F.col("prev") == "correct"
    by = _paired(spark, sf).withColumn("ok", _ok()).groupBy("query_type").agg(*_counts(good=good, bad=~good))
    w = F.when((F.col("good_n") > 0) & (F.col("bad_n") > 0), F.col("good_n") + F.col("bad_n"))
    d = F.col("good_k") / F.when(F.col("good_n") > 0, F.col("good_n")) - F.col("bad_k") / F.when(F.col("bad_n") > 0, F.col("bad_n"))
    total = by.agg(*(F.sum(c).alias(c) for c in ("good_k", "good_n", "bad_k", "bad_n")), (F.sum(d * w) / F.sum(w)).alias("strat"))
    return _contrast(total.withColumn("stratified", F.round("strat", 6)), "good", "bad", ("stratified",))


def propagation_by_type(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("prev") == "correct"
    by = _paired(spark, sf).withColumn("ok", _ok()).groupBy("query_type").agg(*_counts(good=good, bad=~good)).filter("good_n > 0 and bad_n > 0")
    return _contrast(by, "good", "bad", ("query_type",))


def counterfactual_2x2(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.log(spark, sf).filter(F.col("cf_outcome").isNotNull() & ~F.col("query_type").isin(*vocab.EXCLUDED_TYPES))
    real, cf = F.col("outcome") == "correct", F.col("cf_outcome") == "correct"
    t = rows.agg(F.count_if(real & cf).alias("a"), F.count_if(real & ~cf).alias("b"), F.count_if(~real & cf).alias("c"), F.count_if(~real & ~cf).alias("d"))
    chi, p = stats.mcnemar(F.col("b"), F.col("c"))
    fails = F.col("c") + F.col("d")
    return t.select("a", "b", "c", "d", F.round(stats.ratio(F.col("c"), fails), 6).alias("inherited"), F.round(stats.ratio(F.col("d"), fails), 6).alias("intrinsic"), F.round(chi, 6).alias("chi2"), F.round(p, 6).alias("p"))


def wilson_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.log(spark, sf).groupBy("dataset", "query_type").agg(F.sum(_ok()).alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.select("dataset", "query_type", "k", "n", *_rates(F.col("k"), F.col("n")))


def localise_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Each run (dataset, rag) and all pooled, in one pass."""
    rows = v.log(spark, sf).withColumn("ok", _ok())
    own, dep = F.col("query_type").isin(*vocab.SELF_CONTAINED), F.col("query_type").isin(*vocab.HISTORY_DEPENDENT)
    sets = rows.groupingSets([["dataset", "rag"], []], "dataset", "rag").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("k"), *_counts(dep=dep, own=own))
    z, p = stats.two_proportion_z(F.col("dep_k"), F.col("dep_n"), F.col("own_k"), F.col("own_n"))
    return sets.select("dataset", "rag", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(z, 6).alias("z"), F.round(p, 6).alias("p"))


def top_type(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent question type of each dataset; the lesser name of equals."""
    counts = v.log(spark, sf).filter(~F.col("query_type").isin(*vocab.EXCLUDED_TYPES)).groupBy("dataset", "query_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("dataset").agg(F.min_by(F.struct("query_type", "n"), F.struct(-F.col("n"), "query_type")).alias("t")).select("dataset", "t.query_type", "t.n")


def repeat_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, sample deviation and range of the failure rate over the runs of a dataset."""
    runs = outcome_profile(spark, sf)
    return runs.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_runs"), *(F.round(f("failure_rate"), 6).alias(n) for n, f in (("mean", F.avg), ("std", lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))), ("min", F.min), ("max", F.max))))


QUERIES = {f.__name__: f for f in (
    outcome_profile, position_effect, position_contrast, type_effect, type_contrast, type_effect_clean, propagation, propagation_by_type, counterfactual_2x2, wilson_rates, localise_grouping_sets, top_type, repeat_summary,
)}

_OK = "(coalesce(outcome = 'correct', false))::INT"
_DEP, _OWN, _EXC = in_(vocab.HISTORY_DEPENDENT), in_(vocab.SELF_CONTAINED), in_(vocab.EXCLUDED_TYPES)


def _rates_sql(k: str = "k", n: str = "n") -> str:
    low, high = wilson(k, n)
    return f"{r6(f'{k} / {n}', 'rate')}, {r6(low, 'low')}, {r6(high, 'high')}"


def _contrast_sql(src: str, one: str, two: str, sign: str = "", keys: str = "") -> str:
    c = (f"{one}_k", f"{one}_n", f"{two}_k", f"{two}_n")
    z, p = two_z(*c)
    delta = f"{sign}(CASE WHEN {c[1]} > 0 THEN {c[0]} / {c[1]} ELSE 0 END - CASE WHEN {c[3]} > 0 THEN {c[2]} / {c[3]} ELSE 0 END)"
    return f"SELECT {keys} {', '.join(c)}, {r6(delta, 'delta')}, {r6(z, 'z')}, {r6(p, 'p')} FROM ({src})"


def _kn(name: str, cond: str) -> str:
    return f"coalesce(sum({_OK}) FILTER ({cond}), 0)::BIGINT AS {name}_k, count(*) FILTER ({cond}) AS {name}_n"


_PAIRED = f"SELECT * FROM (SELECT *, lag(outcome) OVER (PARTITION BY conversation_id ORDER BY turn_id) AS prev FROM log) WHERE prev IS NOT NULL AND query_type NOT IN {_EXC}"
_GROUPS = f"{_kn('dep', f'query_type IN {_DEP}')}, {_kn('own', f'query_type IN {_OWN}')}"
_GOODBAD = f"""{_kn('good', "prev = 'correct'")}, {_kn('bad', "prev <> 'correct'")}"""
_CURVE = f"""SELECT *, row_number() OVER (ORDER BY turn_id) <= greatest(1, count(*) OVER () // 3) AS early, row_number() OVER (ORDER BY turn_id) > count(*) OVER () - greatest(1, count(*) OVER () // 3) AS late
    FROM (SELECT turn_id, sum({_OK})::BIGINT AS k, count(*) AS n FROM log WHERE query_type NOT IN {_EXC} GROUP BY turn_id)"""
_PROFILE = """SELECT rag, dataset, count(*) AS n, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'hallucinated') AS hallucinated,
    count(*) FILTER (outcome = 'abstained') AS abstained, round(count(*) FILTER (outcome IN ('wrong', 'hallucinated')) / count(*), 6) AS failure_rate FROM log GROUP BY rag, dataset"""
_chi, _p = mcnemar("b", "c")
_z, _zp = two_z("dep_k", "dep_n", "own_k", "own_n")
SQL = {
    "outcome_profile": sql(_PROFILE, "log"),
    "position_effect": sql(f"SELECT turn_id, k, n, {_rates_sql()}, early, late FROM ({_CURVE})", "log"),
    "position_contrast": sql(_contrast_sql(f"SELECT {', '.join(f'(sum({x}) FILTER ({g}))::BIGINT AS {g}_{x}' for g in ('early', 'late') for x in ('k', 'n'))} FROM ({_CURVE})", "early", "late"), "log"),
    "type_effect": sql(
        f"SELECT query_type, CASE WHEN query_type IN {_DEP} THEN 'history' WHEN query_type IN {_OWN} THEN 'self' ELSE 'none' END AS type_group, k, n, {_rates_sql()} FROM (SELECT query_type, sum({_OK})::BIGINT AS k, count(*) AS n FROM log GROUP BY query_type)", "log"
    ),
    "type_contrast": sql(_contrast_sql(f"SELECT {_GROUPS} FROM log", "dep", "own", "-"), "log"),
    "type_effect_clean": sql(_contrast_sql(f"SELECT {_GROUPS} FROM ({_PAIRED}) WHERE prev = 'correct'", "dep", "own", "-"), "log"),
    "propagation": sql(
        _contrast_sql(
            f"""SELECT sum(good_k)::BIGINT AS good_k, sum(good_n)::BIGINT AS good_n, sum(bad_k)::BIGINT AS bad_k, sum(bad_n)::BIGINT AS bad_n,
                  round(sum((good_k / good_n - bad_k / bad_n) * (good_n + bad_n)) FILTER (good_n > 0 AND bad_n > 0) / sum(good_n + bad_n) FILTER (good_n > 0 AND bad_n > 0), 6) AS stratified
                FROM (SELECT query_type, {_GOODBAD} FROM ({_PAIRED}) GROUP BY query_type)""",
            "good", "bad", keys="stratified,",
        ),
        "log",
    ),
    "propagation_by_type": sql(_contrast_sql(f"SELECT * FROM (SELECT query_type, {_GOODBAD} FROM ({_PAIRED}) GROUP BY query_type) WHERE good_n > 0 AND bad_n > 0", "good", "bad", keys="query_type,"), "log"),
    "counterfactual_2x2": sql(
        f"""SELECT a, b, c, d, round(c / (c + d), 6) AS inherited, round(d / (c + d), 6) AS intrinsic, {r6(_chi, 'chi2')}, {r6(_p, 'p')} FROM (
              SELECT count(*) FILTER (r AND f) AS a, count(*) FILTER (r AND NOT f) AS b, count(*) FILTER (NOT r AND f) AS c, count(*) FILTER (NOT r AND NOT f) AS d
              FROM (SELECT outcome = 'correct' AS r, cf_outcome = 'correct' AS f FROM log WHERE cf_outcome IS NOT NULL AND query_type NOT IN {_EXC}))""",
        "log",
    ),
    "wilson_rates": sql(f"SELECT dataset, query_type, k, n, {_rates_sql()} FROM (SELECT dataset, query_type, sum({_OK})::BIGINT AS k, count(*) AS n FROM log GROUP BY ALL)", "log"),
    "localise_grouping_sets": sql(
        f"SELECT dataset, rag, n, k, round(k / n, 6) AS rate, {r6(_z, 'z')}, {r6(_zp, 'p')} FROM (SELECT dataset, rag, count(*) AS n, sum({_OK})::BIGINT AS k, {_GROUPS} FROM log GROUP BY GROUPING SETS ((dataset, rag), ()))", "log"
    ),
    "top_type": sql(f"SELECT dataset, query_type, n FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, query_type) AS r FROM (SELECT dataset, query_type, count(*) AS n FROM log WHERE query_type NOT IN {_EXC} GROUP BY ALL)) WHERE r = 1", "log"),
    "repeat_summary": sql(f"SELECT dataset, count(*) AS n_runs, round(avg(failure_rate), 6) AS mean, round(coalesce(stddev_samp(failure_rate), 0), 6) AS std, min(failure_rate) AS min, max(failure_rate) AS max FROM ({_PROFILE}) GROUP BY dataset", "log"),
}
