"""Registered queries of the engine's own operators over the test tables, with the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import insights, query, statistics
from .. import store, surface
from ..operators.query import group_by, page, predicate
from ..sources import payload
from . import grid_queries

EIGHT = query.FUNCTIONS
R4 = "floor({} * 10000 + 0.5) / 10000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_row(spark: SparkSession, found: dict, kinds: str) -> DataFrame:
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    return spark.createDataFrame([tuple(found[n] for n in names)], kinds)


def agg_global_all8(spark, d):
    df = table(spark, d, "lineitem")
    return query.aggregates(df, "l_extendedprice", list(EIGHT))


def group_by_multi(spark, d):
    aggs = [{"column": "l_extendedprice", "func": "mean"}, {"column": "l_quantity", "func": "sum"}, {"column": "l_quantity", "func": "count"}, {"column": "l_discount", "func": "median"}]
    return group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], aggs, "sum_l_quantity")


def filter_and_or(spark, d):
    df = table(spark, d, "orders")
    clause = {"and": [{"column": "o_totalprice", "op": ">", "value": 1000}, {"or": [{"column": "o_orderstatus", "op": "=", "value": "F"}, {"column": "o_orderpriority", "op": "contains", "value": "urgent"}]}]}
    return df.where(predicate(df, clause)).select("o_orderkey", "o_totalprice")


def filter_in(spark, d):
    df = table(spark, d, "customer")
    return df.where(predicate(df, {"column": "c_nationkey", "op": "in", "value": [1, 3.0, "5"]})).select("c_custkey", "c_nationkey")


def filter_not_in_nulls(spark, d):
    df = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return df.where(predicate(df, {"column": "status", "op": "not_in", "value": ["F", "O"]})).select("o_orderkey", "status")


def filter_not_equal_nulls(spark, d):
    df = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))
    return df.where(predicate(df, {"column": "price", "op": "!=", "value": 5})).agg(F.count("*").alias("n"), F.count("price").alias("with_price"))


def retrieve_sorted_page(spark, d):
    df = table(spark, d, "orders").withColumn("_row_id", F.col("o_orderkey"))
    return page(df, "o_totalprice", True, 10, 25, ["o_totalprice", "o_orderkey"])


def sort_desc_nulls_first(spark, d):
    df = table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 500 != 0, F.col("o_totalprice"))).withColumn("_row_id", F.col("o_orderkey"))
    return page(df, "price", True, 0, 50, ["o_orderkey", "price"])


def filter_numeric_contains(spark, d):
    df = table(spark, d, "orders")
    return df.where(predicate(df, {"column": "o_orderkey", "op": "contains", "value": 5})).select("o_orderkey")


def filter_contains(spark, d):
    df = table(spark, d, "part")
    return df.where(predicate(df, {"column": "p_name", "op": "contains", "value": "A"})).select("p_partkey", "p_name")


def filter_comparisons(spark, d):
    df = table(spark, d, "orders")
    clauses = [{"column": "o_totalprice", "op": op, "value": v} for op, v in ((">=", 1000.5), ("<=", "200000"), ("<", 250000))]
    return df.where(predicate(df, {"and": clauses})).select("o_orderkey")


def filter_condition(spark, d):
    prices = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), F.col("o_totalprice").cast("string"))).when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string"))
    return query.filter_by_condition(table(spark, d, "orders").withColumn("price", prices), "price", ">", "150000").select("o_orderkey", "price")


def sort_text(spark, d):
    df = table(spark, d, "customer").withColumn("_row_id", F.col("c_custkey")).withColumn("segment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return page(df, "segment", False, 0, 50, ["c_custkey", "segment"])


def underscored(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.replace(".", "_") for c in df.columns))


def json_flatten(spark, d):
    return underscored(payload.flatten_frame(payload.parsed_column(table(spark, d, "events").select("event_id", "props"), "props")))


def explode_turns(spark, d):
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.struct("role", "text").alias("said"))).alias("turns"))
    return underscored(payload.explode_frame(nested))


def fingerprint_dedup(spark, d):
    return table(spark, d, "documents").groupBy(store.fingerprint_column(F.col("text")).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def slot_keys(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", store.key_column(F.concat_ws(" ", "source", "lang"), store.fingerprint_column(F.col("text"))).alias("key"))


def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", surface.token_estimate(F.col("text")).alias("tokens"))


def profiled(spark, d, name, columns):
    return payload.profile_frame(table(spark, d, name), columns)


def schema_profile(spark, d):
    found = profiled(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"])
    return found.unionByName(profiled(spark, d, "events", ["event_id", "event_type", "props"])).select("column", "nulls", "scanned", "non_null_count", "unique_count", "unique_ratio", "base_type", "confidence")


def col_stats_numeric(spark, d):
    return profiled(spark, d, "lineitem", ["l_quantity", "l_extendedprice", "l_linenumber"]).select("column", "min", "max", "mean", "median", "std")


def col_stats_dates(spark, d):
    df = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return payload.profile_frame(df).select("column", "base_type", "unique_count", "min_date", "max_date")


def top_values(spark, d):
    found = profiled(spark, d, "customer", ["c_mktsegment", "c_name"]).unionByName(profiled(spark, d, "orders", ["o_orderpriority"]))
    return found.select("column", F.posexplode("top_values").alias("place", "x")).select("column", "place", "x.value", "x.count")


def string_entropy(spark, d):
    return profiled(spark, d, "customer", ["c_mktsegment", "c_name"]).select("column", F.round("string_entropy", 5).alias("string_entropy"), F.round("avg_length", 5).alias("avg_length"))


def semantic_tags(spark, d):
    df = table(spark, d, "customer").select("c_name", "c_mktsegment", F.concat(F.lit("$"), F.col("c_acctbal").cast("string")).alias("money"), F.concat(F.col("c_nationkey").cast("string"), F.lit("%")).alias("share"))
    df = df.withColumn("object", F.to_json(F.struct("c_name"))).withColumn("list", F.lit('[{"a": 1}]')).withColumn("long", F.repeat("c_name", 4))
    return payload.profile_frame(df).select("column", F.array_join("semantic_tags", ",").alias("tags"))


def linear_fit(spark, d):
    found = statistics.fit_linear(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return one_row(spark, {k: round(v, 4) if isinstance(v, float) else v for k, v in found.items()}, "slope double, intercept double, r2 double, samples long")


def regress_2(spark, d):
    found = statistics.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    by = {x["driver"]: round(x["coefficient"], 3) for x in found["drivers"]}
    return one_row(spark, {"samples": found["samples"], "r2": round(found["r2"], 4), "b_quantity": by["l_quantity"], "b_discount": by["l_discount"]}, "samples long, r2 double, b_quantity double, b_discount double")


def partial_corr(spark, d):
    return one_row(spark, statistics.partial_correlate(table(spark, d, "lineitem"), "l_extendedprice", "l_discount", ["l_quantity"]), "samples long, raw_correlation double, partial_correlation double")


def rank_corr(spark, d):
    found = statistics.rank_correlate(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return one_row(spark, found["pairs"][0] | {"samples": found["samples"]}, "samples long, spearman double, pearson double")


def chi_squared(spark, d):
    return one_row(spark, statistics.chi_squared(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), "samples long, chi_squared double, dof int, cramers_v double")


def anova(spark, d):
    return one_row(spark, statistics.anova(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), "samples long, n_groups int, f_statistic double, eta_squared double")


def distribution(spark, d):
    found = statistics.distribution(table(spark, d, "events"), "value")
    return one_row(spark, found | found["quantiles"], "count long, mean double, median double, std double, skewness double, kurtosis double, min double, max double, p5 double, p25 double, p50 double, p75 double, p95 double, normality_pvalue double, shape_label string")


def histogram(spark, d):
    found = statistics.distribution(table(spark, d, "lineitem"), "l_quantity")
    return spark.createDataFrame([(i, x, n, found["shape_label"]) for i, (x, n) in enumerate(zip(found["histogram"]["edges"], found["histogram"]["counts"]))], "bin int, edge double, n long, shape_label string")


def benford(spark, d):
    found = statistics.benford(table(spark, d, "lineitem"), "l_extendedprice")
    return spark.createDataFrame([(x["digit"], x["observed_pct"]) for x in found["digits"]], "digit int, observed_pct double")


def outliers(spark, d):
    found = statistics.outliers(table(spark, d, "events").withColumn("_row_id", F.col("event_id")), ["value"])["field_summaries"][0]
    return one_row(spark, found, "outlier_count long, high long, low long, total_values long")


def vif_2(spark, d):
    found = statistics.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(x["field"], round(x["vif"], 2)) for x in found["vif_results"]], "field string, vif double")


def mutual_info(spark, d):
    return one_row(spark, statistics.mutual_information(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 4)["pairs"][0], "mutual_info double, normalized_mi double")


def autocorrelation(spark, d):
    found = statistics.autocorrelation(table(spark, d, "events").withColumn("_row_id", F.col("event_id")), "value", "event_id", 8, lexical=False)
    return spark.createDataFrame([(x["lag"], x["acf"], x["lag"] in found["significant_lags"], found["significance_threshold"], found["dominant_period"], found["is_stationary_hint"]) for x in found["acf_values"]], "lag int, acf double, significant boolean, threshold double, dominant_period int, is_stationary_hint boolean")


def changepoints(spark, d):
    found = statistics.changepoints(table(spark, d, "orders").withColumn("_row_id", F.col("o_orderkey")), "o_totalprice", "o_orderkey", 10, 1.5, lexical=False)
    return spark.createDataFrame([(x["index"], x["magnitude"], x["confidence"], x["mean_before"], x["mean_after"]) for x in found["changepoints"]], "index long, magnitude double, confidence double, mean_before double, mean_after double")


def ergodicity(spark, d):
    found = statistics.ergodicity(table(spark, d, "events").withColumn("_row_id", F.col("event_id")), "value", "event_id", lexical=False)
    return spark.createDataFrame([(*x.values(), found["ergodicity_ratio"], found["is_ergodic"]) for x in found["time_averages_by_window"]], "window int, mean_of_means double, spread_of_means double, n_chunks long, ergodicity_ratio double, is_ergodic boolean")


def entropy_spectrum(spark, d):
    df = table(spark, d, "orders").where("o_orderkey <= 400").withColumn("_row_id", F.col("o_orderkey"))
    found = statistics.entropy_spectrum(df, "o_totalprice", "o_orderkey", 4, lexical=False)
    return spark.createDataFrame([(*x.values(), found["complexity_type"]) for x in found["entropy_spectrum"]], "scale int, sample_entropy double, series_length long, complexity_type string")


def symmetry(spark, d):
    found = statistics.symmetry_scan(table(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"])
    return spark.createDataFrame([(x["type"], x.get("field", x.get("field_a")), x.get("field_b"), x.get("skewness", x.get("ks_distance"))) for x in found["symmetries"]], "type string, field string, field_b string, measure double")


def symmetry_gap(spark, d):
    df = table(spark, d, "lineitem").select("l_discount", (F.col("l_discount") * 1.02).alias("raised"))
    found = [x for x in statistics.symmetry_scan(df, ["l_discount", "raised"])["symmetries"] if "field_b" in x]
    return spark.createDataFrame([(x["field_a"], x["field_b"], x["ks_distance"]) for x in found], "field_a string, field_b string, ks_distance double")


def copula_tail(spark, d):
    return one_row(spark, statistics.copula_tail(table(spark, d, "part").withColumn("_row_id", F.col("p_partkey")), "p_size", "p_retailprice"), "samples long, upper_tail_dependence double, lower_tail_dependence double, kendall_tau double")


def cluster(spark, d):
    found = statistics.cluster(table(spark, d, "part"), ["p_size", "p_retailprice"], 3)
    return spark.createDataFrame([(x["cluster"], x["size"]) for x in found["clusters"]], "cluster int, size long")


def polynomial(spark, d):
    return one_row(spark, statistics.polynomial_test(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "samples long, degree_1_r2 double, degree_3_r2 double, best_degree int")


def interactions(spark, d):
    df = table(spark, d, "lineitem").withColumn("value", F.col("l_extendedprice") * (1 - F.col("l_discount") * 5))
    found = statistics.interaction_screen(df, "value", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(x["field_a"], x["field_b"], x["r2_a"], x["r2_b"]) for x in found["interactions"]], "field_a string, field_b string, r2_a double, r2_b double")


def importance(spark, d):
    found = statistics.feature_importance(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(x["field"], x["importance_score"]) for x in found["importances"]], "field string, importance double")


def bottleneck(spark, d):
    return one_row(spark, statistics.information_bottleneck(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"), "samples long, preserved_info double, compression_ratio double")


def best_driver(spark, d):
    found = insights.best_driver(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return one_row(spark, {k: round(v, 4) if isinstance(v, float) else v for k, v in found.items()}, "driver string, samples long, slope double, intercept double, r2 double, corr double")


def divergence(spark, d):
    found = insights.divergence(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(x["target_quantile_bucket"], *x["target_range"], x["rows"], x["latent_spread_score"]) for x in found], "bucket int, low double, high double, rows long, spread double")


def counterfactual(spark, d):
    df = table(spark, d, "lineitem")
    found = insights.counterfactual(df, insights.best_driver(df, "l_extendedprice", ["l_quantity"]), "minimize", 20_000.0)
    reach = {k: round(v, 3) for k, v in found["reach_value_estimate"].items()}
    return one_row(spark, found | found["suggested_action"] | {k: found["law"][k] for k in ("r2", "corr")} | reach, "driver string, driver_direction string, r2 double, corr double, current_target_mean double, desired_target_value double, required_driver_value double, delta_driver_from_mean double")


def surprises(spark, d):
    df = table(spark, d, "lineitem").withColumn("_row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return insights.surprises(df, "l_quantity", "l_extendedprice", 20).select("row_index", rounded(F.col("residual"), 2).alias("residual"))


def regimes(spark, d):
    found = insights.regimes(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", threshold=0.0)
    return spark.createDataFrame([(x["between_bucket"], x["target_jump"]) for x in found], "between_bucket string, target_jump double")


ALL = (agg_global_all8, group_by_multi, filter_numeric_contains, filter_contains, filter_comparisons, filter_condition, sort_text, slot_keys, schema_profile, col_stats_numeric, col_stats_dates, top_values, string_entropy, semantic_tags, histogram, entropy_spectrum, symmetry_gap, divergence, counterfactual, filter_and_or, filter_in, filter_not_in_nulls, filter_not_equal_nulls, retrieve_sorted_page, sort_desc_nulls_first, json_flatten, explode_turns, fingerprint_dedup, token_estimate, linear_fit, regress_2, partial_corr, rank_corr, chi_squared, anova, distribution, benford, outliers, vif_2, mutual_info, autocorrelation, changepoints, ergodicity, symmetry, copula_tail, cluster, polynomial, interactions, importance, bottleneck, best_driver, surprises, regimes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL} | grid_queries.queries()


def oracle_sql() -> dict[str, str]:
    mean = lambda c: R4.format(f"avg({c})")
    total = lambda c: R4.format(f"sum({c})")
    median = lambda c: f"case when count({c}) % 2 = 0 then {R4.format(f'median({c})')} else median({c}) end"
    x, y, z = "l_quantity", "l_extendedprice", "l_discount"
    cov = lambda a, b: f"covar_pop({a}, {b})"
    r6 = lambda e: f"floor(({e}) * 1000000 + 0.5) / 1000000"
    # nearest-rank edges, and the first bucket whose upper edge isn't below the value
    edges = lambda c, bins: f"(select list(v order by i) from (select {c} as v, row_number() over (order by {c}) - 1 as i, count(*) over () as n from lineitem) where i in (select floor((n - 1) * b / {bins} + 0.5) from range(1, {bins + 1}) r(b)))"
    place = lambda c, e, bins: f"least({bins - 1}, {' + '.join(f'({c} > {e}[{b}])::int' for b in range(1, bins + 1))})"
    part = lambda by: f"select -sum(p * ln(p)) as h from (select count(*) / sum(count(*)) over () as p from b group by {by})"
    return grid_queries.oracle_sql() | {
        "agg_global_all8": f"select {total(y)} as sum, {mean(y)} as mean, {median(y)} as median, min({y}) as min, max({y}) as max, {R4.format(f'stddev_pop({y})')} as std, count({y}) as count, count(distinct {y}) as count_distinct from lineitem",
        "group_by_multi": f"select l_returnflag, l_linestatus, {mean(y)} as mean_l_extendedprice, {total(x)} as sum_l_quantity, count({x}) as count_l_quantity, {median(z)} as median_l_discount from lineitem group by all",
        "filter_and_or": "select o_orderkey, o_totalprice from orders where o_totalprice > 1000 and (o_orderstatus = 'F' or contains(lower(o_orderpriority), 'urgent'))",
        "filter_in": "select c_custkey, c_nationkey from customer where c_nationkey in (1, 3, 5)",
        "filter_not_in_nulls": "select o_orderkey, status from (select *, case when o_orderkey % 3 <> 0 then o_orderstatus end as status from orders) where status is null or status not in ('F', 'O')",
        "filter_not_equal_nulls": "select count(*) as n, count(price) as with_price from (select case when o_orderkey % 4 <> 0 then o_totalprice end as price from orders) where price is distinct from 5",
        "retrieve_sorted_page": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls first, o_orderkey limit 25 offset 10",
        "sort_desc_nulls_first": "select o_orderkey, price from (select o_orderkey, case when o_orderkey % 500 <> 0 then o_totalprice end as price from orders) order by price desc nulls first, o_orderkey limit 50",
        "filter_numeric_contains": "select o_orderkey from orders where contains(cast(o_orderkey::double as varchar), '5.0')",
        "filter_contains": "select p_partkey, p_name from part where contains(lower(p_name), 'a')",
        "filter_comparisons": "select o_orderkey from orders where o_totalprice >= 1000.5 and o_totalprice <= 200000 and o_totalprice < 250000",
        "filter_condition": "select o_orderkey, o_totalprice::varchar as price from orders where o_orderkey % 3 <> 0 and o_orderkey % 7 <> 0 and o_totalprice > 150000",
        "sort_text": "select c_custkey, case when c_custkey % 5 <> 0 then c_mktsegment end as segment from customer order by coalesce(segment, 'null'), c_custkey limit 50",
        "slot_keys": "select doc_id, trim(regexp_replace(lower(left(concat_ws(' ', source, lang), 20)), '[^a-z0-9]', '_', 'g'), '_') || '_' || left(sha256(text), 6) as key from documents",
        "schema_profile": " union all ".join(
            f"select '{c}' as column, (count(*) - count({v}))::bigint as nulls, count(*)::bigint as scanned, count({v})::bigint as non_null_count, count(distinct {v})::bigint as unique_count, floor(count(distinct {v}) / count({v}) * 1000000 + 0.5) / 1000000 as unique_ratio, '{k}' as base_type, 1.0::double as confidence from {t}"
            for t, c, k in (("orders", "o_orderkey", "numeric"), ("orders", "o_orderpriority", "string"), ("orders", "o_totalprice", "numeric"), ("orders", "o_orderdate", "datetime"), ("events", "event_id", "numeric"), ("events", "event_type", "string"), ("events", "props", "dict"))
            for v in [f"nullif({c}::varchar, '')"]
        ),
        "col_stats_numeric": " union all ".join(f"select '{c}' as column, min({c})::double as min, max({c})::double as max, {r6(f'avg({c})')} as mean, case when count(*) % 2 = 0 then {r6(f'median({c})')} else median({c}) end as median, {r6(f'stddev_pop({c})')} as std from lineitem" for c in (x, y, "l_linenumber")),
        "col_stats_dates": "select 'day' as column, 'date' as base_type, count(distinct d)::bigint as unique_count, min(d) as min_date, max(d) as max_date from (select strftime(o_orderdate, '%Y-%m-%d') as d from orders)",
        "top_values": " union all ".join(f"(select '{c}' as column, (row_number() over (order by count(*) desc, {c}) - 1)::int as place, {c} as value, count(*)::bigint as count from {t} group by {c} order by place limit 5)" for t, c in (("customer", "c_mktsegment"), ("customer", "c_name"), ("orders", "o_orderpriority"))),
        "string_entropy": " union all ".join(f"select '{c}' as column, round(-sum(p * log2(p)), 5) as string_entropy, round((select avg(length({c})) from customer), 5) as avg_length from (select count(*) / (select count(*) from customer) as p from customer group by {c})" for c in ("c_mktsegment", "c_name")),
        "semantic_tags": "select * from (values ('c_name', ''), ('c_mktsegment', 'categorical'), ('money', 'currency'), ('share', 'categorical,percent'), ('object', 'json_stringified_dict,record_like'), ('list', 'json_stringified_list,list_of_dicts'), ('long', 'free_text')) t(\"column\", tags)",
        "histogram": "with s as (select min(l_quantity) a, (max(l_quantity) - min(l_quantity)) / 15 w, avg(l_quantity) m, stddev_pop(l_quantity) d from lineitem), k as (select avg(pow((l_quantity - m) / d, 3)) sk, avg(pow((l_quantity - m) / d, 4)) - 3 ku from lineitem, s), h as (select least(14, floor((l_quantity - a) / w))::int as bin, count(*) n from lineitem, s group by 1) select bin, floor((a + bin * w) * 1000000 + 0.5) / 1000000 as edge, n::bigint as n, case when abs(sk) < 0.5 and abs(ku) < 1 then 'normal' when sk > 1 then 'right_skewed' when sk < -1 then 'left_skewed' when ku > 3 then 'heavy_tailed' when abs(sk) < 0.3 and ku < -1 then 'uniform' else 'other' end as shape_label from h, s, k",
        "entropy_spectrum": f"with o as (select o_totalprice as v, row_number() over (order by o_orderkey) - 1 as i from orders where o_orderkey <= 400), t as (select 0.15 * stddev_pop(v) as tol, count(*) as n from o), c as (select s, i // s as i, avg(v) as v, any_value(n // s) as m from o, t, range(1, 5) r(s) where i < n // s * s group by s, i // s), w as (select a.s, a.i, a.m, a.v as x, b.v as y, c.v as z from c a join c b on b.s = a.s and b.i = a.i + 1 left join c on c.s = a.s and c.i = a.i + 2), p as (select a.s, any_value(a.m) as m, count(*) filter (a.i < a.m - 2 and b.i < a.m - 2 and abs(a.x - b.x) <= tol and abs(a.y - b.y) <= tol) as shorter, count(*) filter (a.i < a.m - 3 and b.i < a.m - 3 and abs(a.x - b.x) <= tol and abs(a.y - b.y) <= tol and abs(a.z - b.z) <= tol) as longer from w a join w b on a.s = b.s and a.i < b.i, t group by a.s), e as (select s, m, case when longer > 0 and shorter > 0 then {R4.format('-ln(longer / shorter)')} else 0 end as e from p), f as (select min(e) lo, max(e) hi, max(e) filter (s = 1) as a, max(e) filter (s = 4) as z from e) select s::int as scale, e::double as sample_entropy, m::bigint as series_length, case when a > 1.5 * z then 'decreasing' when z > 1.5 * a then 'increasing' when hi / (lo + 1e-12) < 1.3 then 'scale_invariant' else 'mixed' end as complexity_type from e, f",
        "symmetry_gap": f"with a as (select l_discount v, row_number() over (order by l_discount) n from lineitem), b as (select l_discount * 1.02 v, row_number() over (order by l_discount) n from lineitem) select 'l_discount' as field_a, 'raised' as field_b, {R4.format('max(abs(a.v - b.v)) / greatest(max(abs(a.v)), max(abs(b.v)))')} as ks_distance from a join b using (n)",
        "symmetry": "with s as (" + " union all ".join(f"select '{c}' as f, avg(pow(({c} - m) / d, 3)) as k from lineitem, (select avg({c}) m, stddev_pop({c}) d from lineitem)" for c in ("l_discount", "l_tax", "l_quantity")) + f"), g as (" + " union all ".join(f"select '{a}' as f, '{b}' as g, max(abs(a.v - b.v)) / greatest(max(abs(a.v)), max(abs(b.v))) as k from (select {a} v, row_number() over (order by {a}) n from lineitem) a join (select {b} v, row_number() over (order by {b}) n from lineitem) b using (n)" for a, b in (("l_discount", "l_tax"), ("l_discount", "l_quantity"), ("l_tax", "l_quantity"))) + f") select 'reflection_symmetry' as type, f as field, null::varchar as field_b, {R4.format('k')} as measure from s where abs(k) < 0.2 union all select 'permutation_symmetry', f, g, {R4.format('k')} from g where k < 0.1",
        "interactions": f"with t as (select *, {y} * (1 - l_discount * 5) as v from lineitem), k as (select 'l_quantity' as f, regr_r2(v, l_quantity) as k from t union all select 'l_discount', regr_r2(v, l_discount) from t union all select 'l_tax', regr_r2(v, l_tax) from t) select a.f as field_a, b.f as field_b, {R4.format('a.k')} as r2_a, {R4.format('b.k')} as r2_b from k a, k b where (a.f, b.f) in (('l_quantity', 'l_discount'), ('l_quantity', 'l_tax'), ('l_discount', 'l_tax'))",
        "divergence": f"with e as (select {edges(y, 4)} as e), b as (select {place(y, 'e', 4)} as b, l.*, e from lineitem l, e), g as (select b, any_value(e) as e, count(*) as n, " + " + ".join(f"(max({c}) - min({c})) / abs(avg({c}))" for c in (x, z, "l_tax")) + f" as s, (select min({y}) from lineitem) as lo from b group by b) select b as bucket, floor((case when b = 0 then lo else e[b] end) * 1000000 + 0.5) / 1000000 as low, {r6('e[b + 1]')} as high, n::bigint as rows, {r6('s / 3')} as spread from g",
        "counterfactual": f"with f as (select regr_slope({y}, {x}) b, regr_intercept({y}, {x}) a, corr({y}, {x}) c, avg({y}) m, avg({x}) d from lineitem) select 'l_quantity' as driver, case when b < 0 then 'increase' else 'decrease' end as driver_direction, {R4.format('c * c')} as r2, {R4.format('c')} as corr, round({r6('m')}, 3) as current_target_mean, 20000.0::double as desired_target_value, round({r6('(20000 - a) / b')}, 3) as required_driver_value, round({r6('(20000 - a) / b - d')}, 3) as delta_driver_from_mean from f",
        "json_flatten": "select event_id, cast(json_extract(props, '$.k') as bigint) as props_k from events",
        "explode_turns": "select conv_id, turn as turns_turn, role as turns_said_role, text as turns_said_text from conversations",
        "fingerprint_dedup": "select sha256(text) as fingerprint, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
        "token_estimate": "select doc_id, ((length(text) + 3) // 4)::bigint as tokens from documents",
        "linear_fit": f"select round(regr_slope({y}, {x}), 4) as slope, round(regr_intercept({y}, {x}), 4) as intercept, round(regr_r2({y}, {x}), 4) as r2, count(*) as samples from lineitem",
        "regress_2": f"with m as (select count(*) as n, {cov(x, x)} as a, {cov(x, z)} as b, {cov(z, z)} as c, {cov(x, y)} as p, {cov(z, y)} as q, var_pop({y}) as v from lineitem), s as (select *, (p * c - q * b) / (a * c - b * b) as s, (q * a - p * b) / (a * c - b * b) as t from m) select n as samples, round({r6('(s * p + t * q) / v')}, 4) as r2, round({r6('s')}, 3) as b_quantity, round({r6('t')}, 3) as b_discount from s",
        "mutual_info": f"with e as (select {edges(x, 4)} as ex, {edges(y, 4)} as ey), b as (select {place(x, 'ex', 4)} as i, {place(y, 'ey', 4)} as j from lineitem, e), h as (select ({part('i')}) as hi, ({part('j')}) as hj, ({part('i, j')}) as hij) select {r6('greatest(0, hi + hj - hij)')} as mutual_info, {r6('greatest(0, hi + hj - hij) / least(hi, hj)')} as normalized_mi from h",
        "regimes": f"with e as (select {edges(x, 6)} as e), b as (select {place(x, 'e', 6)} as b, avg({y}) as m from lineitem, e group by 1), l as (select r.b, coalesce(m, 0) as m from range(6) r(b) left join b on b.b = r.b) select k.b || '->' || l.b as between_bucket, {R4.format('(l.m - k.m)')} as target_jump from l k join l on l.b = k.b + 1",
        "ergodicity": f"with s as (select value as v, row_number() over (order by event_id) - 1 as i, count(*) over () as n, avg(value) over () as g from events where value is not null), c as (select w, c, avg(v) as m, any_value(g) as g from s, (values (10), (25), (50), (100)) t(w), (values (0), (1), (2)) k(k), lateral (select i // (w // 2) - k as c) where w < n and c >= 0 and i >= c * (w // 2) and i < c * (w // 2) + w and c <= (n - w) // (w // 2) group by w, c), z as (select w, {R4.format('avg(m)')} as a, {R4.format('sqrt(avg((m - g) * (m - g)))')} as s, count(*) as n from c group by w), r as (select max(s) filter (w = 100) / max(s) filter (w = 10) / sqrt(10 / 100) as r from z) select w as window, a as mean_of_means, s as spread_of_means, n as n_chunks, {R4.format('r')} as ergodicity_ratio, r > 0.5 and r < 2 as is_ergodic from z, r",
        "changepoints": f"with recursive s as (select o_totalprice as v, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n, stddev_pop(o_totalprice) over () as d from orders), h as (select i, avg(v) over (order by i rows between current row and 9 following) as y, avg(v) over (order by i rows between 10 preceding and 1 preceding) as x, d, n from s), k as (select i, x, y, abs(y - x) / d as z from h where i >= 10 and i < n - 10 and z > 1.5), t as (select (select min(i) from k) as i union all select (select min(k.i) from k where k.i >= t.i + 10) from t where t.i is not null) select k.i as index, {R4.format('z')} as magnitude, {R4.format('least(1, z / 3)')} as confidence, {R4.format('x')} as mean_before, {R4.format('y')} as mean_after from t join k on k.i = t.i",
        "partial_corr": f"with c as (select corr({y}, {z}) as ab, corr({y}, {x}) as ac, corr({z}, {x}) as bc, count(*) as n from lineitem) select n as samples, {R4.format('ab')} as raw_correlation, {R4.format('((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)))')} as partial_correlation from c",
        "rank_corr": f"with k as (select *, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part) select count(*) as samples, {R4.format('corr(a, b)')} as spearman, {R4.format('corr(p_size, p_retailprice)')} as pearson from k",
        "chi_squared": f"with c as (select o_orderstatus a, o_orderpriority b, count(*) n from orders group by all), l as (select a, sum(n) na from c group by a), r as (select b, sum(n) nb from c group by b), t as (select sum(n) n from c), x as (select sum((coalesce(c.n, 0) - na * nb / t.n) * (coalesce(c.n, 0) - na * nb / t.n) / (na * nb / t.n))::double as chi, any_value(t.n)::double as n from l cross join r cross join t left join c using (a, b)), k as (select (select count(*) from l) as ka, (select count(*) from r) as kb) select n::bigint as samples, {R4.format('chi')} as chi_squared, ((ka - 1) * (kb - 1))::int as dof, {R4.format('sqrt(chi / n / (least(ka, kb) - 1))')} as cramers_v from x, k",
        "anova": f"with g as (select l_returnflag, count(*) n, avg({y}) m, var_pop({y}) v from lineitem group by 1), s as (select sum(n)::double n, count(*)::int k, sum(n * m) / sum(n) gm, sum(n * v) w from g), b as (select sum(g.n * (m - gm) * (m - gm)) as b from g, s) select n::bigint as samples, k as n_groups, {R4.format('(b / (k - 1)) / (w / (n - k))')} as f_statistic, floor(b / (b + w) * 1000000 + 0.5) / 1000000 as eta_squared from s, b",
        "distribution": f"with s as (select avg(value) m, stddev_pop(value) d, count(value) n from events), k as (select avg(pow((value - m) / d, 3)) sk, avg(pow((value - m) / d, 4)) - 3 ku from events, s) select any_value(n) as count, {r6('any_value(m)')} as mean, {r6('median(value)')} as median, {r6('any_value(d)')} as std, {R4.format('any_value(sk)')} as skewness, {R4.format('any_value(ku)')} as kurtosis, {r6('min(value)')} as min, {r6('max(value)')} as max, " + ", ".join(f"{r6(f'quantile_cont(value, {q})')} as p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + f", {r6('exp(-any_value(n / 6 * (sk * sk + ku * ku / 4)) / 2)')} as normality_pvalue, any_value(case when abs(sk) < 0.5 and abs(ku) < 1 then 'normal' when sk > 1 then 'right_skewed' when sk < -1 then 'left_skewed' when ku > 3 then 'heavy_tailed' when abs(sk) < 0.3 and ku < -1 then 'uniform' else 'other' end) as shape_label from events, s, k",
        "benford": f"with t as (select regexp_extract(cast(abs({y}) as varchar), '[1-9]')::int as digit from lineitem where {y} <> 0) select digit, floor(100.0 * count(*) / (select count(*) from t) * 100 + 0.5) / 100 as observed_pct from t group by digit",
        "outliers": "with s as (select avg(value) m, stddev_pop(value) d, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, count(value) n from events), h as (select value > m as up from events, s where abs(value - m) / d > 3 or value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) select count(*) as outlier_count, count(*) filter (up) as high, count(*) filter (not up) as low, (select n from s) as total_values from h",
        "vif_2": f"with c as (select round(least(999, 1 / (1 - corr({x}, {y}) * corr({x}, {y}))), 2) as vif from lineitem) select '{x}' as field, vif from c union all select '{y}', vif from c",
        "autocorrelation": f"with s as (select value - avg(value) over () as v, var_pop(value) over () as d, count(*) over () as n, row_number() over (order by event_id) as i from events), c as (select k::int as lag, sum(a.v * b.v) / any_value(a.n * a.d) as x, any_value(2 / sqrt(a.n)) as t from s a, range(1, 9) r(k), s b where b.i = a.i + k group by k), q as (select *, {R4.format('x')} as acf from c), p as (select min(lag) as p from (select lag, acf, t, lag(acf) over (order by lag) as l, lead(acf) over (order by lag) as r from q) where acf > l and acf > r and acf > t) select lag, acf, abs(x) > t as significant, {R4.format('t')} as threshold, p as dominant_period, (select abs(max(acf) filter (lag = 1) - max(acf) filter (lag = 5)) > 0.3 from q) as is_stationary_hint from q, p",
        "best_driver": f"with c as (" + " union all ".join(f"select '{c}' as driver, regr_r2({y}, {c}) as r2, corr({y}, {c}) as corr, regr_slope({y}, {c}) as slope, regr_intercept({y}, {c}) as intercept, count(*) as samples from lineitem" for c in (x, z, "l_tax")) + ") select driver, samples, round(slope, 4) as slope, round(intercept, 4) as intercept, round(r2, 4) as r2, round(corr, 4) as corr from c order by c.r2 desc limit 1",
        "surprises": f"with f as (select regr_slope({y}, {x}) b, regr_intercept({y}, {x}) a from lineitem) select l_orderkey * 10 + l_linenumber as row_index, floor(({y} - a - b * {x}) * 100 + 0.5) / 100 as residual from lineitem, f order by abs({y} - a - b * {x}) desc, 1 limit 20",
    }
