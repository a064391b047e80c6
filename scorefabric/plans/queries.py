"""Queries over the provided tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorefabric.functions import diff
from scorefabric.functions import expressions as X
from scorefabric.operators import contracts, folds, models, quantiles, resampling, sequences, similarity, stats
from scorefabric.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of few large files over all cores before per-row work; tables of many files stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def r6(c) -> F.Column:
    return F.round(c, 6)


EDGES, LABELS = [0, 500, 1500, 4000, 1_000_000], ["<=500", "500-1500", "1500-4000", ">4000"]
BIN_SQL = "case when n_chars is null or n_chars<=0 then 'nan' when n_chars<=500 then '<=500' when n_chars<=1500 then '500-1500' when n_chars<=4000 then '1500-4000' when n_chars<=1000000 then '>4000' else 'nan' end"
SPLIT_SQL = "case when doc_id%5=0 then 'test' else 'train' end"
TOK_SQL = "regexp_extract_all(lower(coalesce(text,'')),'[a-z0-9'']+')"


def split_of(key: str):
    return F.when(F.col(key) % 5 == 0, "test").otherwise("train")


# ---- projections, filters, joins, sets ----


@query("select l_returnflag, l_linestatus, l_discount>0.05 and l_quantity<10 as gated, count(*) n, round(avg(l_extendedprice),4) mean_price from lineitem group by all")
def gate_flag(spark, d):
    li = t(spark, d, "lineitem")
    gate = (F.col("l_discount") > 0.05) & (F.col("l_quantity") < 10)
    return li.groupBy("l_returnflag", "l_linestatus", gate.alias("gated")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query(f"select {BIN_SQL} bucket, lang, count(*) n, round(avg(n_chars),6) mean_chars from documents group by all")
def duration_buckets(spark, d):
    b = X.right_closed(F.col("n_chars"), EDGES, LABELS)
    return t(spark, d, "documents").groupBy(b.alias("bucket"), "lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("n_chars")).alias("mean_chars"))


@query(f"""select {SPLIT_SQL} split, count(n_chars) n, round(avg(n_chars),6) mean, round(stddev_samp(n_chars),6) sd, min(n_chars) low, quantile_cont(n_chars,0.25) q25, quantile_cont(n_chars,0.5) q50, quantile_cont(n_chars,0.75) q75, max(n_chars) high from documents group by all""")
def split_union_profile(spark, d):
    docs = t(spark, d, "documents")
    both = docs.where("doc_id % 5 = 0").withColumn("split", F.lit("test")).unionByName(docs.where("doc_id % 5 <> 0").withColumn("split", F.lit("train")), allowMissingColumns=True)
    out = stats.describe(both, "n_chars", ["split"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "sd")})


@query("select (select count(*) from (select doc_id from documents intersect select doc_id from labels)) both_n, (select count(*) from (select doc_id from documents except select doc_id from labels)) unlabelled, (select count(*) from (select doc_id from labels except select doc_id from documents)) orphans, (select count(*) from (select source from documents union select lang from documents)) names")
def set_checks(spark, d):
    docs, lab = t(spark, d, "documents"), t(spark, d, "labels")
    a, b = docs.select("doc_id"), lab.select("doc_id")
    names = docs.select("source").union(docs.select("lang")).distinct()
    one = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    return one(a.intersect(b), "both_n").join(one(a.distinct().join(b, "doc_id", "left_anti"), "unlabelled")).join(one(b.distinct().join(a, "doc_id", "left_anti"), "orphans")).join(one(names, "names"))


@query(f"select d.doc_id, {SPLIT_SQL.replace('doc_id', 'd.doc_id')} split, case when d.doc_id%5<>0 then l.quality end label, coalesce(l.toxic,0) toxic, case when trim(coalesce(d.lang,''))='' then '[empty]' else d.lang end lang from documents d left join labels l on l.doc_id=d.doc_id")
def left_join_masked_label(spark, d):
    docs, lab = t(spark, d, "documents"), t(spark, d, "labels")
    j = docs.select("doc_id", "lang", split_of("doc_id").alias("split")).join(lab, "doc_id", "left")
    return j.select("doc_id", "split", F.when(F.col("split") == "train", F.col("quality")).alias("label"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.when(F.trim(F.coalesce("lang", F.lit(""))) == "", "[empty]").otherwise(F.col("lang")).alias("lang"))


@query("""select d.lang, count(*) n, sum(l.toxic)::bigint toxic_view, round(avg(s.n_src),6) n_src_docs from documents d join labels l using(doc_id) left join (select source, count(*) n_src from documents group by source) s using(source) group by d.lang""")
def feature_fold_join(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    parts = [docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_src")).withColumnsRenamed({"n_src": "n_src_docs"})]
    base = docs.join(t(spark, d, "labels").withColumnsRenamed({"toxic": "toxic_view"}), "doc_id")
    return contracts.join_features(base, parts, ["source"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic_view").alias("toxic_view"), r6(F.avg("n_src_docs")).alias("n_src_docs"))


@query("select lang, count(*) n from documents where doc_id not in (select doc_id from labels where toxic=1) and doc_id in (select doc_id from labels) group by lang")
def noise_anti_join(spark, d):
    docs, lab = t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels")
    return docs.join(lab.where("toxic = 1"), "doc_id", "left_anti").join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# ---- aggregates ----


@query("select o_custkey, count(*) n, round(stddev_samp(o_totalprice),4) sd from orders group by 1 having count(*)>1")
def having_multi_groups(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd")).where("n > 1")


@query("select round(avg(sd),4) within_sd, count(sd) n from (select stddev_samp(o_totalprice) sd from orders group by o_custkey)")
def within_group_sd(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.stddev_samp("o_totalprice").alias("sd")).agg(F.round(F.avg("sd"), 4).alias("within_sd"), F.count("sd").alias("n"))


@query("select o_custkey, count(distinct o_orderstatus) k from orders group by 1 having count(distinct o_orderstatus)>1")
def leakage_groups(spark, d):
    return contracts.groups_across(t(spark, d, "orders"), "o_custkey", "o_orderstatus").withColumnRenamed("folds", "k")


@query("select l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber) rn from lineitem) where rn=1")
def argmin_per_group(spark, d):
    cols = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_shipdate"]
    m = t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min(F.struct(*cols)).alias("m"))
    return m.select("l_returnflag", *[F.col(f"m.{c}") for c in cols])


@query("select c_nationkey, c_custkey, c_acctbal, rn from (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) rn from customer) where rn<=3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("select o_orderpriority, count(*) n, round(count(*)*1.0/(select count(*) from orders),6) share from orders group by 1")
def value_shares(spark, d):
    return stats.value_counts(t(spark, d, "orders"), "o_orderpriority", normalise=True).withColumn("share", r6(F.col("share")))


@query("select lang, cast(count(*) filter (where source='src1') as bigint) n_src1, cast(count(*) filter (where source='src2') as bigint) n_src2, round(count(*) filter (where source='src1')*1.0/sum(count(*) filter (where source='src1')) over (),6) share_src1, round(count(*) filter (where source='src2')*1.0/sum(count(*) filter (where source='src2')) over (),6) share_src2 from documents group by lang")
def crosstab_shares(spark, d):
    return stats.crosstab(t(spark, d, "documents"), "lang", "source", ["src1", "src2"]).withColumns({c: r6(F.col(c)) for c in ("share_src1", "share_src2")})


def _scored(spark, d):
    """Vectors with a grade 1 + label / 2 (5 at most) and a linear score of the first coordinates."""
    e = t(spark, d, "embeddings")
    y = F.least(1 + F.col("label") * 0.5, F.lit(5.0))
    p = 3.0 + sum((F.col("embedding")[i].cast("double") * (1 if i % 2 else -1) for i in range(8)), F.lit(0.0))
    return e.select("vec_id", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("vec_id") % 4).alias("cohort"), y.alias("y"), p.alias("p"))


SCORED_SQL = "(select vec_id, case when vec_id%5=0 then 'test' else 'train' end split, vec_id%4 cohort, least(1+label*0.5,5.0)::double y, 3.0::double-embedding[1]::double+embedding[2]::double-embedding[3]::double+embedding[4]::double-embedding[5]::double+embedding[6]::double-embedding[7]::double+embedding[8]::double p from embeddings)"


@query(f"select cohort, count(*) n, round(sqrt(avg((p-y)*(p-y))),6) rmse, round(avg(abs(p-y)),6) mae, round(avg(p-y),6) bias, round(corr(y,p),6) r, round((sqrt(avg((p-y)*(p-y)))+1-corr(y,p))/2,6) composite from {SCORED_SQL} group by cohort")
def metrics_report(spark, d):
    out = stats.cohort_profile(_scored(spark, d), "cohort", "y", "p")
    return out.withColumns({c: r6(F.col(c)) for c in ("rmse", "mae", "bias", "r", "composite")})


@query(f"with s as {SCORED_SQL}, m as (select cohort, avg((p-y)*(p-y)) mse from s where split='train' group by 1), k as (select cohort, count(*) k from s where split='test' group by 1) select round(sqrt(sum(mse*k)/sum(k)),6) test_mix_rmse from m join k using(cohort)")
def test_mix_rmse(spark, d):
    s = _scored(spark, d)
    return stats.test_mix_rmse(s.where("split = 'train'"), s.where("split = 'test'"), "cohort", "y", "p").select(r6(F.col("test_mix_rmse")).alias("test_mix_rmse"))


@query("""with j as (select d.n_chars::double n_chars, length(d.text)-length(replace(d.text,' ','')) as spaces, l.quality::double y from documents d join labels l using(doc_id)), long as (select 'n_chars' feature, n_chars x, y from j union all select 'spaces', spaces::double, y from j), rk as (select feature, rank() over (partition by feature order by x)+(count(*) over (partition by feature,x)-1)/2.0 rx, rank() over (partition by feature order by y)+(count(*) over (partition by feature,y)-1)/2.0 ry from long) select feature, count(*) n, round(corr(rx,ry),6) rho from rk group by feature""")
def spearman_rank(spark, d):
    j = t(spark, d, "documents").select("doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces")).join(t(spark, d, "labels"), "doc_id")
    return stats.spearman(j, ["n_chars", "spaces"], "quality").withColumn("rho", r6(F.col("rho")))


@query("select l_orderkey, l_linenumber, rank() over (order by l_quantity)+(count(*) over (partition by l_quantity)-1)/2.0 as rk from lineitem")
def average_ranks(spark, d):
    return stats.ranks_by_count(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "rk").select("l_orderkey", "l_linenumber", "rk")


@query("with b as (select cast(least(floor((l_extendedprice-0)/2500.0),39) as int) bin from lineitem where l_extendedprice between 0 and 100000) select bin, count(*) n, round(count(*)/(sum(count(*)) over ()*2500.0),10) density from b group by bin")
def histogram_density(spark, d):
    return stats.histogram(t(spark, d, "lineitem"), "l_extendedprice", 0, 100_000, 40).withColumn("density", F.round("density", 10))


@query("select l_returnflag, count(l_quantity) n, round(avg(l_quantity),6) mean, round(stddev_samp(l_quantity),6) sd, min(l_quantity) low, quantile_cont(l_quantity,0.25) q25, quantile_cont(l_quantity,0.5) q50, quantile_cont(l_quantity,0.75) q75, max(l_quantity) high from lineitem group by 1")
def box_stats(spark, d):
    return stats.describe(t(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).withColumns({c: r6(F.col(c)) for c in ("mean", "sd")})


@query("select user_id, min(event_type) mode_type from (select user_id, event_type, rank() over (partition by user_id order by count(*) desc) r from events group by user_id, event_type) where r=1 group by user_id")
def mode_with_ties(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("mode_type"))


@query("with q as (select quantile_cont(l_extendedprice,[0.25,0.5,0.75]) q from lineitem) select case when l_extendedprice<=q[1] then 0 when l_extendedprice<=q[2] then 1 when l_extendedprice<=q[3] then 2 else 3 end bucket, count(*) n, round(avg(l_quantity),6) mean_qty from lineitem, q group by 1")
def quartile_buckets(spark, d):
    return stats.quantile_buckets(t(spark, d, "lineitem"), "l_extendedprice", "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("mean_qty"))


@query("with f as (select l_returnflag, count(*) n, regr_slope(l_extendedprice,l_quantity) s, regr_intercept(l_extendedprice,l_quantity) c from lineitem group by 1) select l_returnflag, round(avg(case when n>20 then s*l_quantity+c else l_quantity end),4) calibrated, round(max(s),4) slope from lineitem join f using(l_returnflag) group by 1")
def cohort_recalibration(spark, d):
    li = t(spark, d, "lineitem")
    c = stats.recalibrated(li, "l_returnflag", "l_extendedprice", "l_quantity").groupBy("l_returnflag").agg(F.round(F.avg("calibrated"), 4).alias("calibrated"))
    return c.join(li.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope")), "l_returnflag")


@query("with m as (select median(c_acctbal) m, avg(c_acctbal) a, stddev_pop(c_acctbal) s from customer) select c_custkey, coalesce(case when c_acctbal>=0 then c_acctbal end, (select median(case when c_acctbal>=0 then c_acctbal end) from customer)) filled, round(greatest(least((c_acctbal-a)/s,2.0),-2.0),6) z from customer, m")
def median_fill_zscore(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("filled"), F.col("c_acctbal").alias("z"))
    return contracts.zscore(contracts.fill_medians(c, ["filled"]), ["z"]).withColumn("z", r6(X.clip(F.col("z"), -2, 2)))


# ---- text ----


@query(f"""with k as (select doc_id, {TOK_SQL} tk from documents) select doc_id, len(tk) n, case when len(tk)>0 then round(len(list_distinct(tk))/len(tk),6) else 0.0 end ttr, case when len(tk)>0 then round(list_sum(list_transform(tk, lambda x: length(x)))/len(tk),6) else 0.0 end mean_len, case when len(tk)>0 then round(len(list_filter(tk, lambda x: length(x)>6))/len(tk),6) else 0.0 end long_frac from k""")
def lexical_features(spark, d):
    k = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("tk"))
    n = F.size("tk")
    share = lambda c: F.when(n > 0, r6(c / n)).otherwise(0.0)
    return k.select("doc_id", n.alias("n"), r6(X.ttr(F.col("tk"))).alias("ttr"), share(X.total(F.transform("tk", F.length))).alias("mean_len"), share(F.size(F.filter("tk", lambda x: F.length(x) > 6))).alias("long_frac"))


@query(f"""with k as (select doc_id, {TOK_SQL} tk from documents) select doc_id, case when len(tk)=0 then 0.0 when len(tk)<=50 then floor(len(list_distinct(tk))::double/len(tk)*1e6+0.5)/1e6 else floor(list_sum(list_transform(range(1,len(tk)-48), lambda i: len(list_distinct(tk[i:i+49]))))::double/(50*(len(tk)-49))*1e6+0.5)/1e6 end mattr from k""")
def mattr50(spark, d):
    """Distinct words summed as integers and divided once, so the sixth digit does not depend on the order of sums."""
    from scorefabric.functions.lexical import mattr_of

    return spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", (F.floor(mattr_of(F.col("text")) * 1e6 + 0.5) / 1e6).alias("mattr"))


@query(f"""with k as (select doc_id, list_filter({TOK_SQL}, lambda x: x not in ('the','and')) tk, len({TOK_SQL}) n0 from documents) select doc_id, n0-len(tk) fillers, len(list_filter(range(2,len(tk)+1), lambda i: tk[i]=tk[i-1])) repeats, len(list_filter(range(4,len(tk)+1), lambda i: tk[i]=tk[i-2] and tk[i-1]=tk[i-3])) bigram_repeats, round(100.0*(n0-len(tk))/greatest(n0,1),6) filler_per100 from k""")
def filler_repeat_rates(spark, d):
    k = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("t0")).withColumn("tk", X.without(F.col("t0"), ["the", "and"]))
    gone = F.size("t0") - F.size("tk")
    return k.select("doc_id", gone.alias("fillers"), X.repeats(F.col("tk")).alias("repeats"), X.bigram_repeats(F.col("tk")).alias("bigram_repeats"), r6(100.0 * gone / F.greatest(F.size("t0"), F.lit(1))).alias("filler_per100"))


@query(r"""select conv_id, turn, regexp_replace(lower(trim(role)), '^[^\w'']+|[^\w'']+$', '', 'g') role_token, regexp_replace(role,'[^\w.-]+','_','g') slug, regexp_extract('judge_'||role||'.csv','judge_(.*)\.csv',1) view_name, trim(coalesce(role,''))||' [SEP] '||trim(coalesce(role,'')) two from conversations""")
def text_normalisers(spark, d):
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", X.normal_token(F.col("role")).alias("role_token"), X.slug(F.col("role")).alias("slug"), X.view_of(F.concat(F.lit("judge_"), "role", F.lit(".csv")), "judge").alias("view_name"), X.two_views(F.col("role"), F.col("role")).alias("two"))


def _pairs(spark, d):
    """Words of each turn and of the next."""
    k = t(spark, d, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("a"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the window is light and its partitions are merged for that; the work on pairs is not
    return k.withColumn("b", F.lead("a").over(w)).where("b is not null").repartition(parts)


@query()
def wer_pairs(spark, d):
    """Over whole turns; no SQL, as DuckDB's levenshtein counts bytes."""
    return _pairs(spark, d).select("conv_id", "turn", r6(X.wer(F.col("a"), F.col("b"))).alias("wer"))


def _scripts(spark, d, fillers):
    """Words without fillers, and the edit script between them."""
    k = _pairs(spark, d).select("conv_id", "turn", X.without(F.col("a"), fillers).alias("a"), X.without(F.col("b"), fillers).alias("b"))
    return k.withColumn("steps", diff.script("a", "b"))


@query()
def diff_edit_rates(spark, d):
    k = _scripts(spark, d, X.FILLERS_EDIT)
    return k.select("conv_id", "turn", *[c.alias(n) for n, c in diff.edit_rates(F.col("a"), F.col("b"), F.col("steps")).items()])


@query()
def repair_counts(spark, d):
    k = _scripts(spark, d, X.FILLERS_REPAIR)
    return k.select("conv_id", "turn", *[c.alias(n) for n, c in diff.repairs(F.col("a"), F.col("b"), F.col("steps")).items()])


@query("select event_id, cast(json_extract_string(props,'$.k') as bigint) k from events where json_extract_string(props,'$.k') is not null")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k is not null")


# ---- sequences and windows ----

HOURS = 3600.0


def _events(spark, d):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t(spark, d, "events").select("user_id", "event_id", "event_type", "value", sec.alias("s"))


@query("""with g as (select user_id, event_id, epoch_us(ts)/1e6 s, greatest(epoch_us(ts)/1e6-lag(epoch_us(ts)/1e6) over (partition by user_id order by ts, event_id),0) gap from events), i as (select *, sum(case when gap>=21600 then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) isl from g), r as (select user_id, isl, count(*) len, count(*) filter (where gap>=21600) p0, count(*) filter (where gap>=43200) p1, count(*) filter (where gap>=86400) p2, sum(gap) filter (where gap>=21600) sm, max(gap) mx from i group by all) select user_id, sum(len)::bigint n, sum(p0)::bigint pauses_0, sum(p1)::bigint pauses_1, sum(p2)::bigint pauses_2, round(coalesce(sum(sm)/sum(p0),0),3) pause_mean, round(coalesce(max(mx),0),3) pause_max, round(avg(len),6) mean_run, max(len) max_run from r group by user_id""")
def pause_run_features(spark, d):
    out = sequences.run_features(_events(spark, d), ["user_id"], "s", "s", ["s", "event_id"], [6 * HOURS, 12 * HOURS, 24 * HOURS])
    return out.withColumns({"pause_mean": F.round("pause_mean", 3), "pause_max": F.round("pause_max", 3), "mean_run": r6(F.col("mean_run"))})


@query("""with l as (select user_id, event_type x, lag(event_type,1) over w a, lag(event_type,2) over w b, lag(event_type,3) over w c from events window w as (partition by user_id order by ts, event_id)) select user_id, count(*) n, count(*) filter (where x=a) repeats, count(*) filter (where x=b and a=c) bigram_repeats from l group by user_id""")
def repetition_rates(spark, d):
    return sequences.repetition(_events(spark, d), ["user_id"], ["s", "event_id"], "event_type")


@query("""with l as (select user_id, event_id, event_type x, lag(event_type) over (partition by user_id order by ts, event_id) a from events) select user_id, event_id, x as event_type from l where (a is null or x<>a) and x<>'view'""")
def ctc_collapse(spark, d):
    return sequences.collapse(_events(spark, d), ["user_id"], ["s", "event_id"], "event_type", "view").select("user_id", "event_id", "event_type")


@query("select user_id, time_bucket(interval '1 hour', ts, timestamp '1970-01-01') as start, count(*) n, round(sum(value),4) total from events group by all")
def tumbling_windows(spark, d):
    return sessions.tumbling(t(spark, d, "events"), "ts", "1 hour", ["user_id"], "value").withColumn("total", F.round("total", 4))


@query("with w as (select event_type, value, unnest([time_bucket(interval '1 hour', ts, timestamp '1970-01-01'), time_bucket(interval '1 hour', ts, timestamp '1970-01-01')-interval '1 hour']) as start from events) select event_type, start, count(*) n, round(sum(value),4) total from w group by all")
def sliding_windows(spark, d):
    return sessions.sliding(t(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""with g as (select user_id, ts, event_id, value, case when ts-lag(ts) over (partition by user_id order by ts, event_id) > interval '1 hour' then 1 else 0 end c from events), i as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) isl from g) select user_id, min(ts) as start, count(*) n, round(sum(value),4) total from i group by user_id, isl""")
def session_gap(spark, d):
    return sessions.sessions(t(spark, d, "events"), "ts", "1 hour", ["user_id"], "value").withColumn("total", F.round("total", 4))


@query("select user_id, round(sum(value*(1+event_id%3))/sum(1+event_id%3),6) weighted, round(stddev_samp(value),6) sd from events group by user_id")
def weighted_window_mean(spark, d):
    v = t(spark, d, "events").select("user_id", F.array("value").alias("v"), (1 + F.col("event_id") % 3).alias("w"))
    return sequences.pooled(v, ["user_id"], "v", "w").select("user_id", r6(F.col("mean")[0]).alias("weighted"), r6(F.col("std")[0]).alias("sd"))


# ---- vectors ----


@query("""with s as (select vec_id, list_transform(embedding[1:9], lambda x: exp(x::double*4)) e from embeddings), p as (select vec_id, list_sum(e) mass, list_transform(e, lambda x: x/list_sum(e)) p from s), g as (select *, list_dot_product(p, [1.0,1.5,2.0,2.5,3.0,3.5,4.0,4.5,5.0]::double[]) ex, list_dot_product(p, [1.0,2.25,4.0,6.25,9.0,12.25,16.0,20.25,25.0]::double[]) e2 from p) select vec_id, round(ex,6) as exp, round(sqrt(greatest(e2-ex*ex,0)),6) sd, round(p[1]+p[2]+p[3],6) p_le2, round(p[8]+p[9],6) p_ge45, round(mass,6) mass, 0.5+0.5*list_position(p, list_max(p)) argmax from g""")
def score_distribution(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: F.exp(x.cast("double") * 4)).alias("e"))
    s = X.score_distribution(F.col("e"))
    return e.select("vec_id", *[r6(s[k]).alias(k) for k in ("exp", "sd", "p_le2", "p_ge45", "mass")], s["argmax"].alias("argmax"))


@query("""with v as (select vec_id, list_transform(embedding, lambda x: abs(x::double)*30) v from embeddings) select vec_id, round(list_avg(v),6) nll_mean, round(list_stddev_pop(v),6) nll_sd, round(list_aggregate(v,'quantile_cont',0.9),6) nll_p90, round(list_max(v),6) nll_max, round(len(list_filter(v,lambda x: x<0.5))/len(v),6) nll_frac_low, round(len(list_filter(v,lambda x: x>6))/len(v),6) nll_frac_high from v""")
def surprisal_summary(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) * 30).alias("v"))
    return e.select("vec_id", *[r6(c).alias(k) for k, c in X.surprisal(F.col("v")).items()])


@query("""select vec_id, i, round((embedding[i]::double+embedding[i+16]::double+embedding[i+32]::double+embedding[i+48]::double)/4,6) m from (select vec_id, embedding, unnest(range(1,17)) i from embeddings)""")
def layer_band_mean(spark, d):
    layers = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    return t(spark, d, "embeddings").select("vec_id", F.posexplode(X.band_mean(layers)).alias("i", "m")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("m")).alias("m"))


COS_SQL = "with u as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings), n as (select vec_id, list_transform(v, lambda x: x/sqrt(list_dot_product(v,v))) v from u)"


@query(f"{COS_SQL} select a.vec_id a, b.vec_id b, round(list_dot_product(a.v,b.v),6) sim from n a join n b on a.vec_id<b.vec_id where list_dot_product(a.v,b.v)>0.4")
def cosine_threshold_pairs(spark, d):
    return similarity.cosine_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", 0.4).withColumn("sim", r6(F.col("sim")))


@query(f"{COS_SQL}, m as (select a.vec_id, max(list_dot_product(a.v,b.v)) s from n a join n b on a.vec_id%5=0 and b.vec_id%5<>0 group by 1) select round(quantile_cont(s,0.995),6) threshold from m")
def nn_percentile_threshold(spark, d):
    e = t(spark, d, "embeddings")
    best = similarity.nearest(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), "vec_id", "embedding")
    return quantiles.quantiles(best, "sim", [0.995]).select(r6(F.col("q")[0]).alias("threshold"))


@query(f"with recursive {COS_SQL[5:]}, e as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id<>b.vec_id where list_dot_product(a.v,b.v)>0.45), r as (select vec_id, vec_id c from n union select r.vec_id, e.b from r join e on r.c=e.a) select vec_id, min(c) component from r group by vec_id")
def speaker_components(spark, d):
    e = t(spark, d, "embeddings")
    return similarity.components(similarity.cosine_links(e, "vec_id", "embedding", 0.45), e, "vec_id")


# words of Unicode letters, marks, digits and connectors
TFIDF_SQL = r"with w as (select item_id, list_filter(regexp_extract_all(lower(coalesce(text,'')),'[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+'), lambda x: length(x)>1) ws from benchmark), g as (select item_id, unnest(ws||list_transform(range(1,len(ws)), lambda i: ws[i]||' '||ws[i+1])) term from w), tf as (select item_id, term, count(*) tf from g group by all), df as (select term, count(*) df from tf group by term having count(*)>=2), raw as (select item_id, term, (1+ln(tf))*(ln((1.0+(select count(*) from w))/(1+df))+1) r from tf join df using(term)), tfidf as (select item_id, term, r/sqrt(sum(r*r) over (partition by item_id)) w from raw)"


@query(f"{TFIDF_SQL} select item_id, count(*) terms, round(sum(w),6) mass, round(max(w),6) top from tfidf group by item_id")
def tfidf_weights(spark, d):
    return similarity.tfidf(t(spark, d, "benchmark"), "item_id", "text").groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"), r6(F.sum("w")).alias("mass"), r6(F.max("w")).alias("top"))


@query(f"{TFIDF_SQL}, s as (select a.item_id, b.item_id anchor, round(sum(a.w*b.w),6) sim from tfidf a join tfidf b using(term) where a.item_id<>b.item_id and a.item_id%5<>b.item_id%5 group by all) select item_id, anchor, sim from (select *, row_number() over (partition by item_id order by sim desc, anchor) k from s) where k<=4")
def tfidf_knn_anchors(spark, d):
    return _top_items(t(spark, d, "benchmark"))


def _top_items(items):
    w = similarity.tfidf(items, "item_id", "text")
    pool = items.select("item_id", (F.col("item_id") % 5).alias("fold"))
    return similarity.text_neighbours(w, pool, "item_id", 4, digits=6)


@query("""with e as (select vec_id, (vec_id%5)::int fold, case when y between 2.0 and 2.5 then 0 when y between 3.0 and 3.5 then 1 when y between 4.0 and 4.5 then 2 when y=5.0 then 3 end::int band from (select vec_id, 1+label*0.5::double y from embeddings)), p as (select *, row_number() over (partition by band order by fold, md5('42:'||vec_id), vec_id)-1 place from e where band is not null), n as (select band, count(*) n from p group by band), s as (select band, fold, min(place) first, count(*) own from p group by all), q as (select e.vec_id, n.band, n.n-coalesce(s.own,0) others, s.first, s.own, ('0x'||substr(md5('42:'||e.vec_id||':'||n.band),1,15))::bigint u from e join n on true left join s on s.band=n.band and s.fold=e.fold) select q.vec_id, q.band, p.vec_id anchor from (select *, case when first is null or u%others<first then u%others else u%others+own end pick from q where others>0) q join p on p.band=q.band and p.place=q.pick""")
def band_anchors(spark, d):
    """One of the whole band, of other folds."""
    e = t(spark, d, "embeddings").select("vec_id", (1 + F.col("label") * 0.5).alias("y"), (F.col("vec_id") % 5).cast("int").alias("fold"))
    return similarity.band_anchors(e, e, "vec_id", "y")


@query()
def linkage_groups(spark, d):
    return similarity.linked_groups(t(spark, d, "embeddings"), "vec_id", "embedding", [0.5, 0.4, 0.3])


# ---- folds and models ----


@query("with g as (select distinct o_custkey from orders) select o_custkey, r.repeat::int repeat, (('0x'||substr(md5((42+r.repeat)||':'||o_custkey),1,8))::bigint%5)::int fold from g, (select unnest([0,1,2]) repeat) r")
def group_folds_hash(spark, d):
    return folds.hash_folds(t(spark, d, "orders"), "o_custkey", 5, 3)


@query()
def strat_group_folds(spark, d):
    return folds.stratified_group_folds(t(spark, d, "orders"), "o_custkey", "o_orderpriority", 5, 3)


@query("select c_custkey, ((row_number() over (partition by c_mktsegment order by md5('42:'||c_custkey), c_custkey)-1)%5)::int fold from customer")
def stratified_folds(spark, d):
    return folds.stratified_folds(t(spark, d, "customer"), "c_custkey", "c_mktsegment", 5)


def _views(spark, d):
    e = t(spark, d, "embeddings").withColumn("y", F.when(F.col("vec_id") % 5 != 0, F.least(1 + F.col("label") * 0.5, F.lit(5.0)))).withColumn("g", F.col("vec_id") % 100)
    parts = [e.select(F.lit(f"band{k}").alias("view"), "vec_id", F.slice("embedding", 1 + 16 * k, 32).alias("vec"), "y", "g") for k in (0, 2)]
    f = folds.hash_folds(e, "g", 5, 1)
    return parts[0].union(parts[1]), f


@query()
def ridge_oof(spark, d):
    v, f = _views(spark, d)
    return models.ridge_oof(v, f, "vec_id", "vec", "y", "g").withColumn("pred", r6(F.col("pred")))


@query()
def layer_probe(spark, d):
    v, f = _views(spark, d)
    return models.probe(v, f, "vec_id", "vec", "y", "g")


def _stackable(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_suppkey") % 50).alias("g"), (F.col("l_extendedprice") / 20000).alias("y"), (F.col("l_quantity") / 10).alias("m1"), (F.col("l_quantity") * F.col("l_discount")).alias("m2"), (F.col("l_partkey") / 1000).alias("m3"), (-F.col("l_quantity") / 20).alias("m4"))


@query()
def nnls_stack(spark, d):
    s = _stackable(spark, d)
    w, b = models.fit_stack(s, ["m1", "m2", "m3", "m4"], "y")
    return spark.createDataFrame([(k, round(x, 9)) for k, x in [*w.items(), ("intercept", b)]], "model string, weight double")


@query()
def nested_stack(spark, d):
    s = _stackable(spark, d)
    out = models.nested_stack(s, folds.hash_folds(s, "g", 5, 2), ["m1", "m2", "m3", "m4"], "y", "g", "id")
    return out.agg(*stats.metrics("y", "stack_oof"))


def _by_supplier(spark, d):
    li = t(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("g"), (F.col("l_extendedprice") / 20000).alias("y"), (F.col("l_quantity") / 10 * 0.8).alias("a"), (F.col("l_quantity") / 10).alias("b"))


@query()
def bootstrap_ci(spark, d):
    return stats.bootstrap_summary(resampling.bootstrap(_by_supplier(spark, d), "g", "y", ["a", "b"], 1000))


@query()
def bootstrap_paired(spark, d):
    return stats.paired(resampling.bootstrap(_by_supplier(spark, d), "g", "y", ["a", "b"], 2000), "a", "b")


@query("select count(*) duplicates from (select o_orderkey from orders group by 1 having count(*)>1)")
def contract_unique(spark, d):
    return contracts.duplicates(t(spark, d, "orders"), ["o_orderkey"]).agg(F.count(F.lit(1)).alias("duplicates"))


@query("select * from (select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice, l_orderkey, l_linenumber limit 10)")
def smallest_ten(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_linenumber").limit(10)


@query("select o_orderpriority, o_orderkey from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by md5('42:'||o_orderkey), o_orderkey) k from orders) where k<=2")
def group_samples(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("o_orderkey").cast("string"))), "o_orderkey")
    return t(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 2").drop("k")


from scorefabric.plans import scoring  # noqa: E402,F401  registers its queries
