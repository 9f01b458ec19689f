"""Queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathe.functions import numbers as N
from lathe.functions import protocol as P
from lathe.operators import attention as A
from lathe.operators import compose as C
from lathe.operators import evaluate as E
from lathe.operators import generate as G
from lathe.operators import grammar as H
from lathe.operators import kernels as K
from lathe.operators import matching as M
from lathe.operators import mixes as X
from lathe.operators import ordering as O
from lathe.operators import pools as L
from lathe.operators import relational as R
from lathe.operators import reports as Y
from lathe.operators import scenarios as Z
from lathe.operators import toolbox as B
from lathe.operators import traces as V
from lathe.sources import publish as U
from lathe.sources import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, d, "labels"), "doc_id")


@query("serialize_chat", "select conv_id, string_agg('<'||role||'>'||text||'</'||role||'>'||case when role='assistant' then chr(3) else '' end, chr(10) order by turn) as trace from conversations group by conv_id")
def serialize_chat(s, d):
    return P.serialise(t(s, d, "conversations"))


@query("serialize_instruct", "select conv_id, string_agg('<'||role||'>'||text||'</'||role||'>', chr(10) order by turn) || chr(3) as trace from conversations group by conv_id")
def serialize_instruct(s, d):
    return P.serialise(t(s, d, "conversations"), chat=False)


MASKS = "with b as (select conv_id, turn, role, case when role='assistant' then repeat('1', length(text)+3) else repeat('0', length(text)+2) end as m from conversations), t as (select conv_id, string_agg(m, '0' order by turn) as m from b group by 1)"


def bits(mask):
    return F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "")


@query("mask_counts", MASKS + " select conv_id, length(m) as n_tok, length(replace(m, '0', '')) as n_sup, md5(m) as mask from t")
def mask_counts(s, d):
    x = P.serialise(t(s, d, "conversations")).select("conv_id", P.encode(F.col("trace")).alias("e"))
    mask = bits(F.col("e.mask"))
    return x.select("conv_id", F.size("e.tokens").cast("bigint").alias("n_tok"), F.aggregate("e.mask", F.lit(0).cast("bigint"), lambda a, m: a + m.cast("bigint")).alias("n_sup"), F.md5(mask).alias("mask"))


@query("token_roundtrip", "select conv_id, count(*)::bigint as turns, true as same from conversations group by conv_id")
def token_roundtrip(s, d):
    x = P.serialise(t(s, d, "conversations")).select("conv_id", (P.detokenise(P.tokenise(F.col("trace"))) == F.col("trace")).alias("same"))
    return t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).join(x, "conv_id")


@query("shifted_supervision", MASKS + " select conv_id, length(m)-1 as n_x, length(replace(substr(m, 2), '0', '')) as n_sup, md5(substr(m, 2)) as mask from t")
def shifted_supervision(s, d):
    x = P.serialise(t(s, d, "conversations")).select("conv_id", P.encode(F.col("trace")).alias("e")).select("conv_id", P.shift(F.col("e.tokens"), F.col("e.mask")).alias("z"))
    return x.select("conv_id", F.size("z.x").cast("bigint").alias("n_x"), F.aggregate("z.mask", F.lit(0).cast("bigint"), lambda a, m: a + m.cast("bigint")).alias("n_sup"), F.md5(bits(F.col("z.mask"))).alias("mask"))


@query("token_histogram", "select least(unicode(ch),255)::int as tok, count(*) as n from (select unnest(string_split(text,'')) as ch from documents) where ch<>'' group by 1")
def token_histogram(s, d):
    return P.token_counts(t(s, d, "documents"), "text")


@query("number_list", r"select doc_id, array_to_string(regexp_extract_all(text,'-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?'), '|') as numbers from documents")
def number_list(s, d):
    return t(s, d, "documents").select("doc_id", F.array_join(N.number_literals(F.col("text")), "|").alias("numbers"))


@query("length_gate_starvation", "select source, count(*) filter (n_chars<=4000) as kept, count(*) filter (n_chars>4000) as dropped from documents group by source having count(*) filter (n_chars>4000) > 0.2*count(*)")
def length_gate_starvation(s, d):
    return R.starvation(t(s, d, "documents"), "source", F.col("n_chars") <= 4000)


@query("drop_reasons", "select count(*) filter (n_chars<20)::bigint as too_short, count(*) filter (n_chars>4000)::bigint as too_long, count(*) filter (n_chars between 20 and 4000)::bigint as kept from documents")
def drop_reasons(s, d):
    n = F.col("n_chars")
    return t(s, d, "documents").agg(F.count_if(n < 20).alias("too_short"), F.count_if(n > 4000).alias("too_long"), F.count_if(n.between(20, 4000)).alias("kept"))


@query("exact_split", "select doc_id, (row_number() over (order by ('0x'||md5('42:'||doc_id)[1:8])::BIGINT, doc_id) <= greatest(1, floor((select count(*) from documents)*0.05)))::int as is_val from documents")
def exact_split(s, d):
    return R.exact_split(t(s, d, "documents").select("doc_id"), "doc_id")


@query("rank_family", "select event_id, rank() over (partition by event_type order by value desc)::int as rnk from events")
def rank_family(s, d):
    return O.ranked(t(s, d, "events").select("event_id", "event_type", "value"), "event_type", "value", "rnk", descending=True).select("event_id", F.col("rnk").cast("int").alias("rnk"))


@query("dense_numbers", "select doc_id, row_number() over (order by source, doc_id)-1 as number from documents")
def dense_numbers(s, d):
    return O.numbered(t(s, d, "documents").select("source", "doc_id"), "source", "doc_id").select("doc_id", "number")


@query("running_best", "select event_id, max(value) over w as best, min(value) over w as low from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def running_best(s, d):
    return R.running_extremes(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "best", "low")


@query("patience", "with e as (select *, row_number() over (partition by user_id order by ts,event_id) as step from events), b as (select *, max(value) over (partition by user_id order by step rows unbounded preceding) as best from e), s as (select *, step - max(case when value=best and (step=1 or value>prev) then step end) over (partition by user_id order by step rows unbounded preceding) as since from (select *, lag(best) over (partition by user_id order by step) as prev from b)) select user_id, min(step)::bigint as stop_step from s where since>=4 group by user_id")
def patience(s, d):
    return R.patience_stop(t(s, d, "events"), "user_id", ["ts", "event_id"], "value", 4)


@query("last_n_mean", "select user_id, round(avg(value), 6) as mean from (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r<=50 group by user_id")
def last_n_mean(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t(s, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 50").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("carry_last", "select event_id, last_value(case when value>50 then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events")
def carry_last(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "events").select("event_id", F.last(F.when(F.col("value") > 50, F.col("value")), ignorenulls=True).over(w).alias("carried"))


@query("accuracy_by_kind", "select lang, count(*) as total, sum(quality)::bigint as correct, round(avg(quality), 9) as acc from documents join labels using (doc_id) group by grouping sets ((lang),())")
def accuracy_by_kind(s, d):
    return R.accuracy(labelled(s, d), "lang", "quality").withColumn("acc", F.round("acc", 9))


@query("bucket_accuracy", "select least(n_chars//1000,4)::bigint as bucket, sum(quality)::bigint as ok, count(*) as total from documents join labels using(doc_id) group by 1")
def bucket_accuracy(s, d):
    return R.bucket_accuracy(labelled(s, d), F.floor(F.col("n_chars") / 1000), "quality")


@query("accuracy_interval", "with a as (select source, sum(quality)::double as k, count(*)::double as n from documents join labels using(doc_id) group by 1) select source, round((k/n+1.96*1.96/(2*n))/(1+1.96*1.96/n) - 1.96*sqrt(k/n*(1-k/n)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n), 6) as lo, round((k/n+1.96*1.96/(2*n))/(1+1.96*1.96/n) + 1.96*sqrt(k/n*(1-k/n)/n+1.96*1.96/(4*n*n))/(1+1.96*1.96/n), 6) as hi from a")
def accuracy_interval(s, d):
    a = labelled(s, d).groupBy("source").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = N.wilson_interval(F.col("k"), F.col("n"))
    return a.select("source", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("gate", "with r as (select case when doc_id%2=0 then 'numeric' else 'exact' end as kind, quality=1 as ok from labels) select round(avg(ok::int), 9) as overall, round(avg(ok::int) filter (kind='numeric'), 9) as numeric, round(avg(ok::int) filter (kind='exact'), 9) as exact, avg(ok::int)>=0.75 and avg(ok::int) filter (kind='numeric')>=0.6 and avg(ok::int) filter (kind='exact')>=0.8 as passed from r")
def gate(s, d):
    r = t(s, d, "labels").select(F.when(F.col("doc_id") % 2 == 0, "numeric").otherwise("exact").alias("kind"), (F.col("quality") == 1).alias("ok"))
    return E.gate(r).select(*[F.round(c, 9).alias(c) for c in ("overall", "numeric", "exact")], "passed")


@query("index_percentile", "select lang, max(n_chars) filter (rn=floor(n*0.5)) as p50, max(n_chars) filter (rn=floor(n*0.95)) as p95 from (select lang, n_chars, row_number() over (partition by lang order by n_chars)-1 as rn, count(*) over (partition by lang) as n from documents) group by lang")
def index_percentile(s, d):
    return R.index_percentiles(t(s, d, "documents").select("lang", "n_chars"), "lang", "n_chars", {"p50": 0.5, "p95": 0.95})


@query("length_histogram", "select case when n_chars<500 then '0-499' when n_chars<2000 then '500-1999' when n_chars<8000 then '2000-7999' else '8000+' end as band, count(*) as n, round(count(*)*1.0/(select count(*) from documents), 9) as share from documents group by 1")
def length_histogram(s, d):
    return Y.hop_bands(t(s, d, "documents"), F.col("n_chars"), (0, 500, 2000, 8000)).withColumn("share", F.round("share", 9))


@query("grep_lines", "select doc_id, line_no::bigint as line_no, left(trim(line, ' '),110) as line from (select doc_id, unnest(string_split(text,chr(10))) as line, generate_subscripts(string_split(text,chr(10)),1) as line_no from documents) where contains(lower(line),'the') order by doc_id,line_no limit 20")
def grep_lines(s, d):
    return R.grep(t(s, d, "documents").select("doc_id", "text"), "doc_id", "the")


@query("group_lines", "select source as folder, count(*) as files, sum(length(text)-length(replace(text,chr(10),''))+1)::bigint as lines from documents group by source")
def group_lines(s, d):
    x = t(s, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return E.top_folder_report(x).withColumn("lines", F.col("lines").cast("bigint"))


@query("line_slice", "select doc_id, line_no::bigint as line_no, line from (select doc_id, unnest(string_split(text,chr(10))) as line, generate_subscripts(string_split(text,chr(10)),1) as line_no from documents) where line_no between 2 and 3")
def line_slice(s, d):
    return R.numbered_lines(t(s, d, "documents"), "doc_id").where("line_no BETWEEN 2 AND 3")


@query("anti_unlabelled", "select doc_id from documents anti join labels using (doc_id)")
def anti_unlabelled(s, d):
    return V.pending(t(s, d, "documents").select("doc_id"), t(s, d, "labels"), "doc_id")


@query("semi_labelled", "select doc_id from documents semi join labels using (doc_id)")
def semi_labelled(s, d):
    return t(s, d, "documents").select("doc_id").join(t(s, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("lookup_default", "select d.doc_id, coalesce(l.quality,-1)::int as quality from documents d left join labels l using (doc_id)")
def lookup_default(s, d):
    return R.lookup(t(s, d, "documents").select("doc_id"), t(s, d, "labels").withColumn("quality", F.col("quality").cast("int")), "doc_id", "quality", -1)


@query("pool_merge", "select coalesce(a.k,b.k)::bigint as key, coalesce(a.v,b.v) as value from (select c_nationkey as k, min(c_name) as v from customer group by 1) a full join (select s_nationkey as k, max(s_name) as v from supplier group by 1) b on a.k=b.k")
def pool_merge(s, d):
    old = t(s, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("key")).agg(F.min("c_name").alias("value"))
    new = t(s, d, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("key")).agg(F.max("s_name").alias("value"))
    return R.merge_pools(old, new)


@query("capped_take", "select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 5")
def capped_take(s, d):
    return R.capped_take(t(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("hash_sample", "select doc_id from documents order by ('0x'||md5('7:'||doc_id)[1:8])::BIGINT, doc_id limit 100")
def hash_sample(s, d):
    return t(s, d, "documents").select("doc_id").orderBy(R.draw(7, "doc_id"), "doc_id").limit(100)


@query("weighted_pattern", "select pattern, count(*) as n from (select case when u<35 then 'single' when u<65 then 'chain' when u<85 then 'lookup' else 'chat' end as pattern from (select ('0x'||md5('3:'||doc_id)[1:8])::BIGINT % 100 as u from documents)) group by 1")
def weighted_pattern(s, d):
    return R.weighted_choice(t(s, d, "documents").select("doc_id"), {"single": 35, "chain": 30, "lookup": 20, "chat": 15}, "doc_id", 3).groupBy("pattern").agg(F.count("*").alias("n"))


@query("distinct_collect", "select lang, count(distinct text) as n_distinct from documents group by lang")
def distinct_collect(s, d):
    return t(s, d, "documents").groupBy("lang").agg(F.countDistinct("text").alias("n_distinct"))


@query("distinct_union", "select distinct lang as v from documents union select distinct source from documents")
def distinct_union(s, d):
    x = t(s, d, "documents")
    return x.select(F.col("lang").alias("v")).union(x.select("source")).distinct()


@query("last_message", "select conv_id, arg_max(text, turn) filter (role='user') as last_user, arg_max(text, turn) filter (role='assistant') as last_answer from conversations group by conv_id")
def last_message(s, d):
    pick = lambda role, name: F.max_by("text", F.when(F.col("role") == role, F.col("turn"))).alias(name)
    return t(s, d, "conversations").groupBy("conv_id").agg(pick("user", "last_user"), pick("assistant", "last_answer"))


@query("turn_stats", "select conv_id, count(*)::bigint as turns, max(length(text))::int as longest, round(avg(length(text)),6) as mean from conversations where role<>'system' group by conv_id")
def turn_stats(s, d):
    n = F.length("text")
    return t(s, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query("role_rollup", "select conv_id, string_agg(role, '->' order by turn) as roles from conversations group by conv_id")
def role_rollup(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(P.tool_rollup(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("roles"))


@query("pair_shift", "select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as next_role from conversations")
def pair_shift(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@query("pad_batches", "select conv_id//8 as batch_id, max(n)::bigint as pad_to, (count(*)*max(n)-sum(n))::bigint as waste from (select conv_id, sum(length(text)) as n from conversations group by conv_id) group by 1")
def pad_batches(s, d):
    n = t(s, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return n.groupBy(F.floor(F.col("conv_id") / 8).alias("batch_id")).agg(F.max("n").alias("pad_to"), (F.count("*") * F.max("n") - F.sum("n")).alias("waste"))


@query("mean_pool", "select label, i::bigint as dim, round(avg(e), 9) as mean from (select label, unnest(embedding)::double as e, generate_subscripts(embedding,1) as i from embeddings) group by 1,2")
def mean_pool(s, d):
    return K.mean_pool(t(s, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 9))


@query("softmax_topk", "with x as (select vec_id, generate_subscripts(embedding,1) as k, unnest(embedding)::double as v from embeddings), p as (select *, exp(v)/sum(exp(v)) over (partition by vec_id) as pr from x) select vec_id,k::bigint as k,round(pr/sum(pr) over (partition by vec_id), 9) as w from (select *, row_number() over (partition by vec_id order by pr desc,k) as rn from p) where rn<=2")
def softmax_topk(s, d):
    return K.softmax_topk(t(s, d, "embeddings"), "vec_id", "embedding", 2).withColumn("w", F.round("w", 9))


@query("rms_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double*x))/len(embedding)+1e-6), 9) as rms from embeddings")
def rms_norm(s, d):
    return t(s, d, "embeddings").select("vec_id", F.round(K.rms(F.col("embedding")), 9).alias("rms"))


@query("window_band", "select user_id, event_id, round(avg(value) over (partition by user_id order by ts,event_id rows between 3 preceding and 3 following), 6) as m from events")
def window_band(s, d):
    e = t(s, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    near = A.banded_pairs(e, 3, "user_id", "pos").join(e.select("user_id", F.col("pos").alias("k"), "value"), ["user_id", "k"])
    mean = near.groupBy("user_id", "q").agg(F.round(F.avg("value"), 6).alias("m"))
    return e.join(mean.withColumnRenamed("q", "pos"), ["user_id", "pos"]).select("user_id", "event_id", "m")


@query("nucleus", "with x as (select vec_id, generate_subscripts(embedding,1) as k, unnest(embedding)::double as v from embeddings), p as (select *, exp(v)/sum(exp(v)) over (partition by vec_id) as pr from x), c as (select *, sum(pr) over w as cum, row_number() over w as rn from p window w as (partition by vec_id order by pr desc, k rows unbounded preceding)) select vec_id, count(*) as kept from c where cum<=0.5 or rn=1 group by 1")
def nucleus(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    x = t(s, d, "embeddings").select("vec_id", F.posexplode(K.softmax(v)).alias("k", "pr"))
    return K.top_p(x, "vec_id", "k", "pr", 0.5).groupBy("vec_id").agg(F.count("*").alias("kept"))


@query("contains_join", "select b.item_id, count(d.doc_id) as hits from benchmark b left join documents d on contains(d.text, b.text) group by 1")
def contains_join(s, d):
    b = t(s, d, "benchmark")
    hit = M.containing(t(s, d, "documents"), "doc_id", "text", b, "item_id", "text").groupBy("item_id").agg(F.count("*").alias("n"))
    return R.lookup(b.select("item_id"), hit, "item_id", "n", 0).select("item_id", F.col("n").alias("hits"))


@query("used_words", "select d.doc_id, w.word from documents d join (select distinct unnest(string_split(lower(n_name), '_')) as word from nation union select lower(r_name) from region union select 'the' union select 'tion') w on contains(d.text, w.word)")
def used_words(s, d):
    """Marks of any number in texts of any length, each text read once."""
    w = t(s, d, "nation").select(F.explode(F.split(F.lower("n_name"), "_")).alias("word")).union(t(s, d, "region").select(F.lower("r_name"))).union(s.createDataFrame([("the",), ("tion",)], "word string")).distinct()
    return M.containing(t(s, d, "documents"), "doc_id", "text", w, "word", "word")


@query("tools_in_use", "select conv_id, 'calc' as name from conversations where role='assistant' and (conv_id+turn)%3=2 group by 1")
def tools_in_use(s, d):
    x = chat_bodies(s, d).groupBy("conv_id").agg(F.array_join(F.collect_list("body"), "\n").alias("trace"))
    tools = s.createDataFrame([("calc",), ("web_search",)], "name string")
    return G.used_in(x, "conv_id", "trace", tools)


@query("fuzzy_lookup")
def fuzzy_lookup(s, d):
    """The closest long word of the benchmark, if any, for each long word of the conversations."""
    words = lambda name: t(s, d, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{12,}"), F.lit(0))).alias("w")).distinct()
    return M.closest(words("conversations").withColumnRenamed("w", "query"), words("benchmark").withColumnRenamed("w", "key"), 0.78).withColumn("ratio", F.round("ratio", 9))


@query("toolbox_runs", "with k as (select o_orderkey as call_id, o_custkey as c, o_orderkey%6 as kind from orders) select call_id, case kind when 0 then (c+call_id)::varchar when 1 then 'region '||n_regionkey when 2 then 'not found' when 3 then 'ERROR: unknown tool ''fly''' when 4 then 'ERROR: missing required parameters [''expr'']' else 'region '||n_regionkey end as result from k join nation on n_nationkey=c%25")
def toolbox_runs(s, d):
    facts = t(s, d, "nation").select(F.col("n_nationkey").alias("ord"), F.concat(F.lower("n_name"), F.lit("_")).alias("key"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("value"))
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 6
    nation = F.concat(F.lit("nation_"), (c % 25).cast("string"), F.lit("_"))
    name = F.when(k == 0, "calc").when(k.isin(1, 2), "serch_memory").when(k == 3, "fly").when(k == 4, " calc").otherwise("web_search")
    args = F.when(k == 0, F.to_json(F.struct(F.concat_ws(" + ", c.cast("string"), F.col("o_orderkey").cast("string")).alias("expr")))).when(k == 1, F.to_json(F.struct(nation.alias("key")))).when(k == 2, '{"key":"x"}').when(k == 5, F.to_json(F.struct(F.concat(F.lit("Where is "), nation, F.lit("?")).alias("query")))).otherwise("{}")
    calls = t(s, d, "orders").select(F.col("o_orderkey").alias("call_id"), name.alias("name"), args.alias("arguments"))
    return B.run_calls(calls, facts.select("key", "value"), facts, "2026-01-01T00:00:00").select("call_id", "result")


@query("cascading_lookup", "with f as (select n_nationkey as ord, lower(n_name) as key, 'region '||n_regionkey as value from nation), q as (select 'where is '||lower(n_name)||'?' as query from nation union all select lower(n_name)||'x' from nation), m as (select query, rtrim(query,'?') as q from q) select query, coalesce((select min(value) from f where key=q), (select arg_min(value, ord) from f where contains(q,key) or contains(key,q)), 'no results found') as answer from m")
def cascading_lookup(s, d):
    facts = t(s, d, "nation").select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("key"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("value"))
    asked = t(s, d, "nation").select(F.concat(F.lit("where is "), F.lower("n_name"), F.lit("?")).alias("query")).union(t(s, d, "nation").select(F.concat(F.lower("n_name"), F.lit("x")).alias("query")))
    return R.cascading_lookup(asked, facts)


@query("calc_chain", "select o_orderkey, '('||o_custkey||' + '||o_orderkey||') * 2 // 7' as expr, ((o_custkey+o_orderkey)*2//7)::varchar as value from orders")
def calc_chain(s, d):
    x = t(s, d, "orders").select("o_orderkey", F.format_string("(%d + %d) * 2 // 7", F.col("o_custkey").cast("bigint"), F.col("o_orderkey").cast("bigint")).alias("expr"))
    return x.withColumn("value", N.calc("expr"))


def chat_bodies(s, d):
    """Assistant turns of which a third are free text, a third answers and a third tool calls."""
    k, n = (F.col("conv_id") + F.col("turn")) % 3, F.col("turn").cast("string")
    answer = F.concat(F.lit('{"thought":"t","response":"'), n, F.lit('"}'))
    call = F.concat(F.lit('{"thought":"t","tool_call":{"name":"calc","arguments":{"expr":"'), n, F.lit(' + 1"}}}'))
    return t(s, d, "conversations").where("role = 'assistant'").withColumn("body", F.when(k == 0, F.col("text")).when(k == 1, answer).otherwise(call))


@query("validity", "with b as (select conv_id, (conv_id+turn)%3 as k from conversations where role='assistant') select count(*) as blocks, (count(*) filter (k<>0))::bigint as valid, count(distinct conv_id) as traces, count(distinct conv_id) filter (k=2) as with_call, round((count(*) filter (k<>0))/count(*), 9) as valid_share, round((count(distinct conv_id) filter (k=2))/count(distinct conv_id), 9) as call_share from b")
def validity(s, d):
    return Y.validity(chat_bodies(s, d), "conv_id", "body").withColumn("valid_share", F.round("valid_share", 9)).withColumn("call_share", F.round("call_share", 9))


@query("hop_bands", "with h as (select conv_id, count(*) as n from conversations group by 1), b as (select case when n>=32 then '32+' when n>=16 then '16-31' when n>=8 then '8-15' when n>=4 then '4-7' when n>=2 then '2-3' else '0-1' end as band from h) select band, count(*) as n, round(count(*)/(select count(*) from b), 9) as share from b group by 1")
def hop_bands(s, d):
    h = t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("hops"))
    return Y.hop_bands(h, F.col("hops")).withColumn("share", F.round("share", 9))


@query("most_common", "select source, count(*) as n, min(doc_id) as first from documents group by source order by n desc, first")
def most_common(s, d):
    return Y.most_common(t(s, d, "documents"), "source", "doc_id")


@query("distinct_sorted", "select lang, string_agg(distinct source, ',' order by source) as sources from documents group by lang")
def distinct_sorted(s, d):
    return Y.distinct_sorted(t(s, d, "documents"), "lang", "source").select("lang", F.array_join("values", ",").alias("sources"))


@query("series_summary", "select user_id, max(value) filter (r=1) as final, min(value) as least, round((sum(value) filter (r<=50))/50, 6) as recent from (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) group by 1")
def series_summary(s, d):
    return Y.series_summary(t(s, d, "events"), "user_id", ["ts", "event_id"], "value").withColumn("recent", F.round("recent", 6))


@query("best_step", "select event_id, max(value) over w as best, first_value(event_id) over (partition by user_id, b order by ts, event_id) as best_step from (select *, max(value) over w as b from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)) window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def best_step(s, d):
    return Y.running_best(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_id", "value").select("event_id", "best", "best_step")


RESULTS_SQL = "select event_type as experiment, printf('run_%012d.json', event_id) as file_name, case when event_type<'m' then value end as accuracy, case when event_type>='m' and event_id%3=0 then value end as best_val_loss, null::double as best_loss, case when event_type>='m' and event_id%3=1 then value end as final_loss, event_id from events"


def results(s, d):
    e, v = t(s, d, "events"), F.col("value")
    low = F.col("event_type") < "m"
    return e.select(F.col("event_type").alias("experiment"), F.format_string("run_%012d.json", "event_id").alias("file_name"), F.when(low, v).alias("accuracy"), F.when(~low & (F.col("event_id") % 3 == 0), v).alias("best_val_loss"), F.lit(None).cast("double").alias("best_loss"), F.when(~low & (F.col("event_id") % 3 == 1), v).alias("final_loss"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("timestamp"))


@query("ranked_results", f"with r as ({RESULTS_SQL}), m as (select *, coalesce(accuracy,best_val_loss,best_loss,final_loss,0) as metric, case when accuracy is not null then 'accuracy' when best_val_loss is not null then 'best_val_loss' when best_loss is not null then 'best_loss' when final_loss is not null then 'final_loss' else 'no metric' end as metric_name from r), f as (select *, first_value(metric_name in ('accuracy','no metric')) over (partition by experiment order by file_name) as up from m) select event_id, metric_name, metric, rank() over (partition by experiment order by case when up then -metric else metric end)::int as rank from f")
def ranked_results(s, d):
    return R.ranked_results(results(s, d)).select("event_id", "metric_name", "metric", F.col("rank").cast("int").alias("rank"))


@query("leaderboard_lines", f"with r as ({RESULTS_SQL}), m as (select *, coalesce(accuracy,best_val_loss,final_loss,0) as metric, case when accuracy is not null then 'accuracy' when best_val_loss is not null then 'best_val_loss' when final_loss is not null then 'final_loss' else 'no metric' end as metric_name from r), f as (select *, first_value(metric_name in ('accuracy','no metric')) over (partition by experiment order by file_name) as up from m), k as (select f.*, strftime(ts,'%Y-%m-%d') as stamp, rank() over (partition by experiment order by case when up then -metric else metric end) as rk from f join events using (event_id)) select file_name, '| '||stamp||' | '||experiment||' | #'||rk||' | '||metric_name||printf('=%.4f',metric)||' | - | - | '||coalesce(printf('final=%.4f',final_loss), printf('best=%.4f',null::double), printf('val=%.4f',best_val_loss),'-')||' | '||coalesce(printf('overall=%.1f%%',accuracy*100),'-')||' | - | - | ['||file_name||'](results/'||file_name||') |' as line from k")
def leaderboard_lines(s, d):
    return Y.leaderboard_lines(R.ranked_results(results(s, d))).select("file_name", "line")


@query("gate_reasons", "with r as (select doc_id::varchar as question, case when doc_id%2=0 then 'numeric' else 'exact' end as kind, quality=1 as ok from labels), a as (select avg(ok::int) as o, avg(ok::int) filter (kind='numeric') as n, avg(ok::int) filter (kind='exact') as e from r), w as (select 0 as i, printf('overall accuracy %.2f%% < 75%%', o*100) as why from a where o<0.75 union all select 1, printf('numeric accuracy %.2f%% < 60%%', n*100) from a where n<0.6 union all select 2, printf('exact accuracy %.2f%% < 80%%', e*100) from a where e<0.8 union all select 3, 'required case failed: '||q from (select unnest(['0','3','x']) as q) left join r on question=q where not coalesce(ok,false)) select coalesce(string_agg(why, '; ' order by i, why),'') as reasons, count(*)=0 as passed from w")
def gate_reasons(s, d):
    r = t(s, d, "labels").select(F.col("doc_id").cast("string").alias("question"), F.when(F.col("doc_id") % 2 == 0, "numeric").otherwise("exact").alias("kind"), (F.col("quality") == 1).alias("ok"))
    cases = s.createDataFrame([("0",), ("3",), ("x",)], "question string")
    return E.gate(r, cases=cases).select(F.array_join("reasons", "; ").alias("reasons"), "passed")


@query("bind_surfaces", "select lower(n_name) as surface, 'canonical_'||n_nationkey as canonical from nation where n_nationkey%2=0 union all select 'finish','finish'")
def bind_surfaces(s, d):
    n = t(s, d, "nation")
    schema = n.select(F.lower("n_name").alias("surface")).union(s.createDataFrame([("finish",)], "surface string"))
    names = n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("surface"), F.concat(F.lit("canonical_"), F.col("n_nationkey").cast("string")).alias("canonical"))
    return X.bind_surfaces(schema, names)


@query("renamed", "select n_nationkey, case when n_regionkey=1 then 'new_'||n_name else n_name end as name from nation")
def renamed(s, d):
    n = t(s, d, "nation")
    mapping = n.where("n_regionkey = 1").select(F.col("n_name").alias("old"), F.concat(F.lit("new_"), "n_name").alias("new"))
    return X.renamed(n.select("n_nationkey", F.col("n_name").alias("name")), mapping)


@query("quota_union", "with a as (select doc_id from documents where source='src1' order by doc_id limit 60), b as (select doc_id from documents where source<>'src1' order by doc_id limit (200 - (select count(*) from a))) select doc_id, 'scenario' as origin from a union all select doc_id, 'generated' from b")
def quota_union(s, d):
    x = t(s, d, "documents").select("doc_id", "source")
    part = lambda cond, name: x.where(cond).select("doc_id", F.lit(name).alias("origin"))
    return X.quota_union(part("source = 'src1'", "scenario"), part("source <> 'src1'", "generated"), 200, 0.3, "doc_id")


@query("replay_mix", "select doc_id, false as replay from (select doc_id from documents where lang<>'fr' order by doc_id limit 150) union all select doc_id, true from (select doc_id from documents where lang='fr' order by doc_id limit 50)")
def replay_mix(s, d):
    x = t(s, d, "documents")
    return X.replay_mix(x.where("lang <> 'fr'").select("doc_id"), x.where("lang = 'fr'").select("doc_id"), 200, 0.25, "doc_id")


@query("with_cases", "select n_name as question from nation union all select r_name from region")
def with_cases(s, d):
    return X.with_cases(t(s, d, "nation").select(F.col("n_name").alias("question")), t(s, d, "region").select(F.col("r_name").alias("question")), True)


@query("deep_traces", "select conv_id from conversations group by 1 having count(*)>=4 order by conv_id limit 25")
def deep_traces(s, d):
    n = t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"))
    return X.deep_traces(n, "conv_id", F.col("calls"), 4, 25).select("conv_id")


@query("first_open_call", "select conv_id, min(turn) as pos from conversations where role='assistant' and (conv_id+turn)%3=2 and turn>=2 group by 1")
def first_open_call(s, d):
    x = chat_bodies(s, d).withColumn("call", F.get_json_object("body", "$.tool_call.name"))
    return X.first_open_call(x, "conv_id", "turn", "call", 2).select("conv_id", "pos")


@query("sample_pairs", "with v as (select distinct lang, source from documents), r as (select *, row_number() over (partition by lang order by ('0x'||md5('9:'||lang||':'||source)[1:8])::BIGINT, source) as k from v) select lang, max(source) filter (k=1) as a, max(source) filter (k=2) as b from r where k<=2 group by 1 having count(*)=2")
def sample_pairs(s, d):
    return X.pairs_without_replacement(t(s, d, "documents"), "lang", "source", 9)


@query("grounding", "select o_orderkey, o_orderkey%5<>0 as ok, case when o_orderkey%5=0 then 'hop 1 (calc): value '||(o_custkey+1000000)||' not grounded in prior context' else '' end as problems from orders")
def grounding(s, d):
    used = F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1000000).otherwise(0)
    trace = F.concat(F.lit("<user>add 3 to "), F.col("o_custkey").cast("string"), F.lit('</user>\n<assistant>{"thought":"t","tool_call":{"name":"calc","arguments":{"expr":"'), used.cast("string"), F.lit(' + 3"}}}</assistant>\n<tool name=calc>'), (used + 3).cast("string"), F.lit("</tool>"))
    x = X.grounding(t(s, d, "orders").select("o_orderkey", trace.alias("trace")), "o_orderkey", "trace")
    return x.select("o_orderkey", "ok", F.array_join("problems", "; ").alias("problems"))


@query("z_loss", "with x as (select vec_id, ln(list_sum(list_transform(embedding, lambda e: exp(e::double)))) as z from embeddings) select round(0.0001*sum(z*z)/count(*), 9) as z_loss from x")
def z_loss(s, d):
    return K.z_loss(t(s, d, "embeddings").withColumn("mask", F.lit(1.0)), "embedding", "mask", 0.0001).select(F.round("z_loss", 9).alias("z_loss"))


@query("layer_norm", "with x as (select vec_id, list_transform(embedding, lambda e: e::double) as v from embeddings), m as (select *, list_avg(v) as mu from x), n as (select *, list_avg(list_transform(v, lambda e: (e-mu)*(e-mu))) as va from m) select vec_id, round(list_max(list_transform(v, lambda e: (e-mu)/sqrt(va+1e-5))), 7) as top from n")
def layer_norm(s, d):
    return t(s, d, "embeddings").select("vec_id", F.round(F.array_max(K.layer_norm(F.col("embedding"))), 7).alias("top"))


@query("categorical_draw", "with x as (select vec_id, generate_subscripts(embedding,1)-1 as k, unnest(embedding)::double as v from embeddings), p as (select vec_id, k, exp(v)/sum(exp(v)) over (partition by vec_id) as pr from x), c as (select *, sum(pr) over (partition by vec_id order by k rows unbounded preceding) as cum, ('0x'||md5('7:'||vec_id)[1:8])::BIGINT/4294967296.0 * sum(pr) over (partition by vec_id) as u from p) select vec_id, min(k)::int as k from c where cum>u group by 1")
def categorical_draw(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    p = t(s, d, "embeddings").select("vec_id", F.posexplode(K.softmax(v)).alias("k", "p"))
    return X.categorical_draw(p, "vec_id", "k", "p", 7)


@query("greedy_pick", "with x as (select vec_id, generate_subscripts(embedding,1)-1 as k, unnest(embedding) as v from embeddings), r as (select *, row_number() over (partition by vec_id order by v desc, k) as n from x) select vec_id, k::int as k from r where n=1")
def greedy_pick(s, d):
    p = t(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "p"))
    return X.categorical_draw(p, "vec_id", "k", "p", 7, greedy=True)


@query("collate", "with x as (select turn, row_number() over (order by conv_id, turn)-1 as n, length(text) as l from conversations) select n//8 as batch_id, max(l)::bigint as padded, sum(l)::bigint as kept, (count(*)*max(l)-sum(l))::bigint as filled from x group by 1")
def collate(s, d):
    x = O.numbered(t(s, d, "conversations"), "conv_id", "turn", name="n")
    x = x.select("n", F.array_repeat(F.lit(1), F.length("text")).alias("x"), F.array_repeat(F.lit(2), F.length("text")).alias("y"), F.array_repeat(F.lit(1.0), F.length("text")).alias("mask"))
    got = X.collate(x, "n", 8)
    return got.groupBy("batch_id").agg(F.max(F.size("x")).cast("bigint").alias("padded"), F.sum(F.aggregate("mask", F.lit(0.0), lambda a, m: a + m)).cast("bigint").alias("kept"), F.sum(F.size(F.filter("y", lambda y: y == -100))).cast("bigint").alias("filled"))


@query("observation_view", "with x as (select *, count(*) filter (length(text)>180) over (partition by source order by doc_id rows unbounded preceding) as n from documents) select doc_id, case when length(text)<=180 then text else left(text,400)||chr(10)||'[obs_'||n||': '||least(length(text),8000)||' bytes, showing 0-'||least(length(text),400)||']' end as view from x")
def observation_view(s, d):
    return P.observations(t(s, d, "documents"), "source", "doc_id", "text").select("doc_id", "view")


@query("observation_page", "select doc_id, substr(left(text,8000),1001,400)||chr(10)||'[obs_1: '||least(length(text),8000)||' bytes, showing 1000-'||least(least(length(text),8000),1400)||']' as view from documents where length(text)>1000")
def observation_page(s, d):
    x = t(s, d, "documents").where(F.length("text") > 1000)
    return x.select("doc_id", P.observation_view(F.col("text"), F.lit("obs_1"), F.lit(1000)).alias("view"))


@query("compact_history", "with b as (select conv_id, turn, role, case when role='assistant' then '<tool name=calc>'||text||'</tool>' else '<'||role||'>'||text||'</'||role||'>' end as content, text from conversations), r as (select *, row_number() over (partition by conv_id, role='assistant' order by turn desc) as k, string_split(regexp_replace(text,'^\\s+|\\s+$','','g'),chr(10))[1] as line from b), c as (select *, '<tool name=calc>'||case when length(line)>60 then left(line,60)||'...' else line end||' [elided]</tool>' as short from r) select conv_id, turn, case when role='assistant' and k>1 and length(short)<length(content) then short else content end as content from c")
def compact_history(s, d):
    c, a = t(s, d, "conversations"), F.col("role") == "assistant"
    content = F.when(a, F.concat(F.lit("<tool name=calc>"), "text", F.lit("</tool>"))).otherwise(F.concat(F.lit("<"), "role", F.lit(">"), "text", F.lit("</"), "role", F.lit(">")))
    x = c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("pos"), content.alias("content"))
    return R.compact_history(x, keep=1).select(F.col("trace_id").alias("conv_id"), F.col("pos").alias("turn"), "content")


@query("quantities", r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), v as (select doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') as v from l) select doc_id, count(*) filter (regexp_matches(v, '^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?(\s|$)') or regexp_matches(v, '^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?(\s|$)')) as n from v group by 1")
def quantities(s, d):
    x = R.numbered_lines(t(s, d, "documents"), "doc_id")
    return x.groupBy("doc_id").agg(F.count_if(N.leads_with_quantity(F.col("line"))).alias("n"))


@query("path_inside", r"with p as (select page_id, '/root'||coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') as path from pages), n as (select page_id, path, len(list_filter(string_split(path, '/'), lambda x: x not in ('', '.', '..')))-1 as depth from p) select page_id, (page_id%5)<=depth as ok from n")
def path_inside(s, d):
    """Paths of pages, with some steps up at their ends, below /root: in, as long as steps are no more than folders."""
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    up = F.repeat(F.lit("/.."), (F.col("page_id") % 5).cast("int"))
    x = t(s, d, "pages").select("page_id", F.concat(F.lit("/root"), F.when(path == "", "/").otherwise(path), up).alias("path"))
    return x.select("page_id", L.inside(F.col("path"), "/root").alias("ok"))


@query("answers", "select doc_id, regexp_replace(regexp_replace(trim(text, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '\\s+', ' ', 'g'), '\\.+$', '') as answer, case when contains(text, '.') then left(text, strpos(text,'.')-1) else text end as head, case when contains(text, '.') then substr(text, strpos(text,'.')+1) else '' end as tail from documents")
def answers(s, d):
    x = t(s, d, "documents").select("doc_id", N.plain_answer(F.col("text")).alias("answer"), N.partition(F.col("text"), ".").alias("p"))
    return x.select("doc_id", "answer", "p.head", "p.tail")


@query("small_numbers", "select o_orderkey, least(greatest(o_custkey,1),60)::int as clamped, greatest(64, ((2*o_custkey//3+63)//64)*64)::bigint as width, case when o_totalprice=floor(o_totalprice) then floor(o_totalprice)::bigint::varchar else round(o_totalprice,4)::varchar end as shown, round(-ln(-ln((o_orderkey%97+1)/98.0+1e-10)+1e-10), 9) as noise from orders")
def small_numbers(s, d):
    c = F.col("o_custkey")
    return t(s, d, "orders").select("o_orderkey", N.clamp(c, 1, 60).alias("clamped"), N.swiglu_width(c).alias("width"), N.round_text(F.col("o_totalprice")).alias("shown"), F.round(N.gumbel((F.col("o_orderkey") % 97 + 1) / F.lit(98.0)), 9).alias("noise"))


@query("active_ids", "select distinct id from (select n_regionkey as id from nation union all select n_nationkey%3 from nation) order by id")
def active_ids(s, d):
    return Y.active(t(s, d, "nation").withColumn("k", F.col("n_nationkey") % 3), "n_regionkey", "k")


@query("mean_hops", "select round(avg(n) filter (conv_id%2=0), 9) as reference, round(avg(n) filter (conv_id%2=1), 9) as model from (select conv_id, count(*) as n from conversations group by 1)")
def mean_hops(s, d):
    n = t(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("hops"))
    return Y.mean_hops(n.where("conv_id % 2 = 0"), n.where("conv_id % 2 = 1"), "hops").select(F.round("reference", 9).alias("reference"), F.round("model", 9).alias("model"))


@query("parameter_count", "select sum(p_size*7)::bigint as parameters from part")
def parameter_count(s, d):
    return Y.parameter_count(t(s, d, "part").select(F.array(F.col("p_size").cast("bigint"), F.lit(7).cast("bigint")).alias("shape")))


@query("reconciled", "with o as (select n_name as name, n_regionkey as r from nation where n_nationkey<20), n as (select n_name as name, case when n_nationkey%3=0 then n_regionkey+1 else n_regionkey end as r from nation where n_nationkey>=5) select case when o.name is null or n.name is null or n.r<o.r then 'skip' when o.r=n.r then 'copy' else 'grow' end as kind, count(*) as n from o full join n using (name) group by 1")
def reconciled(s, d):
    n = t(s, d, "nation")
    old = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("rows"), F.lit(4).alias("cols"))
    new = n.where("n_nationkey >= 5").select(F.col("n_name").alias("name"), (F.col("n_regionkey") + F.when(F.col("n_nationkey") % 3 == 0, 1).otherwise(0)).alias("rows"), F.lit(4).alias("cols"))
    return E.reconciled(old, new)


@query("smoothed", "select vec_id, round(list_sum(list_transform(embedding, lambda e: 0.125*e::double + 0.875))/len(embedding), 9) as m from embeddings")
def smoothed(s, d):
    v = F.transform("embedding", lambda e: e.cast("double"))
    y = K.smoothed(v, F.transform("embedding", lambda e: F.lit(1.0)), 3)
    return t(s, d, "embeddings").select("vec_id", F.round(F.aggregate(y, F.lit(0.0), lambda a, e: a + e) / F.size(y), 9).alias("m"))


@query("learning_rate", "select n_nationkey as step, round(case when n_nationkey<5 then 0.01*(n_nationkey+1)/5 else 0.01*(0.1+0.9*0.5*(1+cos(pi()*least((n_nationkey-5)/20.0,1)))) end, 12) as rate, round(case when n_nationkey<5 then 0.01*(n_nationkey+1)/5 else 0.01*(0.2+0.8*0.5*(1+cos(pi()*least((n_nationkey-5)/20.0,1)))) end, 12) as floored from nation")
def learning_rate(s, d):
    step = F.col("n_nationkey")
    return t(s, d, "nation").select(step.alias("step"), F.round(K.learning_rate(step, 5, 25, 0.01), 12).alias("rate"), F.round(K.learning_rate(step, 5, 25, 0.01, floor=0.002), 12).alias("floored"))


@query("divergence", "with e as (select conv_id as trace_id, turn as pos, role as name from conversations), g as (select conv_id as trace_id, turn as pos, case when conv_id%3=1 and turn=1 then 'other' else role end as name from conversations where not (conv_id%3=2 and turn>=2)), j as (select coalesce(e.trace_id,g.trace_id) as trace_id, coalesce(e.pos,g.pos) as pos, case when g.name is null then 'stopped early' when e.name is null then 'kept going' when e.name<>g.name then 'wrong tool' end as kind from e full join g on e.trace_id=g.trace_id and e.pos=g.pos) select trace_id, coalesce(arg_min(kind,pos) filter (kind is not null),'matched') as kind from j group by 1")
def divergence(s, d):
    e = t(s, d, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.lit("").alias("arguments"))
    g = e.where("NOT (trace_id % 3 = 2 AND pos >= 2)").withColumn("name", F.when((F.col("trace_id") % 3 == 1) & (F.col("pos") == 1), "other").otherwise(F.col("name")))
    return R.first_divergence(e, g).select("trace_id", "kind")


def pools(s, d):
    """Facts of parts and stored values of nations: (key, value)."""
    facts = t(s, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".5 units").otherwise(" units")).alias("value"))
    memory = t(s, d, "nation").select(F.lower("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, F.concat((F.col("n_regionkey") + 2).cast("string"), F.lit(" regions"))).otherwise("unknown").alias("value"))
    return facts, memory


def recorded(s, d):
    """What tools said of documents: (pattern, question, tool, arguments, result, answer)."""
    x = t(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "source", "text", "n_chars").where("text IS NOT NULL")
    top = V.cut_at_line(F.array_join(F.slice(F.split("text", "\n"), 1, 3), "\n"))
    hit = F.concat("name", F.lit(":1: "), F.substring(F.trim(F.substring_index("text", "\n", 1)), 1, 80))
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    row = lambda pattern, question, tool, arguments, result, answer: (F.lit(pattern).alias("pattern"), question.alias("question"), F.lit(tool).alias("tool"), F.to_json(arguments).alias("arguments"), result.alias("result"), answer.alias("answer"))
    name, none = F.col("name"), F.lit(None).cast("string")
    reads = x.select(*row("repo_read", say("Show me the first lines of ", name, "."), "read_file", F.struct(name.alias("path"), F.lit(1).alias("start"), F.lit(3).alias("lines")), top, V.read_summary(top)))
    hits = x.select(*row("repo_search", say("What does the first line of ", name, " say?"), "search_code", F.struct(name.alias("query")), hit, V.hit_summary(hit)))
    runs = x.select(*row("sandbox", say("How long is ", name, "?"), "run_python", F.struct(say("print(len(open('", name, "').read()))").alias("code")), F.col("n_chars").cast("string"), none))
    of = x.groupBy("source").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    lists = of.select(*row("repo_list", say("Which files are of ", F.col("source"), "?"), "list_files", F.struct(F.col("source").alias("pattern")), F.col("first"), V.file_summary(F.col("first"))))
    stats = of.select(*row("repo_stats", say("How many files has ", F.col("source"), "?"), "repo_stats", F.struct(F.col("source").alias("pattern")), say(F.col("source"), ": ", F.col("n").cast("string"), " files"), none))
    told = V.described(nation_symbols(s, d)).select(*row("repo_symbol", say("Describe ", name, "."), "describe_symbol", F.struct("name"), F.col("text"), none))
    return reads.unionByName(hits).unionByName(runs).unionByName(lists).unionByName(stats).unionByName(told)


def nation_symbols(s, d):
    source = F.concat(F.lit("class "), "n_name", F.lit(':\n    """A nation."""\n\n    def region(self, year):\n        return '), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return V.symbols(t(s, d, "nation").select(F.format_string("n%02d.py", F.col("n_nationkey").cast("int")).alias("path"), source.alias("text")))


@query("source_symbols", "select printf('n%02d.py', n_nationkey::int) as path, 1 as line, 'class' as kind, n_name as name, null as arguments, 'A nation.' as doc from nation union all select printf('n%02d.py', n_nationkey::int), 4, 'def', 'region', 'self,year', null from nation")
def source_symbols(s, d):
    return nation_symbols(s, d).select("path", "line", "kind", "name", F.array_join("arguments", ",").alias("arguments"), "doc")


def composer(s, d, seed=11):
    facts, memory = pools(s, d)
    thoughts = s.createDataFrame([("calc_call", "I will calculate this."), ("calc_call", "The calculator can do this."), ("chain_last", "That was the last step."), ("web_call", "A search will tell.")], "situation string, text string")
    phrases = s.createDataFrame([("math", "Compute {EXPR}."), ("math", "How much is {EXPR}?"), ("web", "Tell me the {TOPIC}."), ("memory", "What is stored as {KEY}?")], "intent string, text string")
    return C.Composer(facts, memory, "2026-01-01T00:00:00", recorded(s, d), thoughts, phrases, seed)


def as_many(s, d):
    """One trace a conversation of the table."""
    return t(s, d, "conversations").select("conv_id").distinct().count()


@query("composed_traces")
def composed_traces(s, d):
    make = composer(s, d)
    return C.filled(s, make.traces, as_many(s, d))[0]


@query("composed_chats")
def composed_chats(s, d):
    make = composer(s, d, 12)
    return C.filled(s, lambda ids: make.traces(ids, chat=True, systems=("Answer briefly.", "Use the tools.")), as_many(s, d))[0]


@query("conversation_traces")
def conversation_traces(s, d):
    make = composer(s, d, 13)
    return C.filled(s, lambda ids: make.traces(ids, chat=True, weights=C.CONVERSATIONS), as_many(s, d))[0]


@query("mixed_traces")
def mixed_traces(s, d):
    make = composer(s, d, 14)
    return C.filled(s, lambda ids: make.traces(ids, weights=C.MIXED), as_many(s, d))[0]


@query("one_step_traces")
def one_step_traces(s, d):
    make = composer(s, d, 15)
    return C.filled(s, lambda ids: make.traces(ids, weights=C.SIMPLE), as_many(s, d))[0]


@query("starved_patterns")
def starved_patterns(s, d):
    make = composer(s, d, 16)
    return C.starved(C.filled(s, make.traces, as_many(s, d), max_len=420)[1])


def scenario_plans(s, d):
    """A plan a conversation: its users' turns, with some steps each."""
    c = t(s, d, "conversations").where("role = 'user'")
    kinds = F.array(*[F.lit(k) for k in L.KINDS])
    step = lambda i: F.struct(F.element_at(kinds, ((F.col("conv_id") * 3 + F.col("turn") * 5 + i * 3) % len(L.KINDS) + 1).cast("int")).alias("kind"))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), (F.col("conv_id") + F.col("turn")) % 4), step)
    turn = F.struct("turn", F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(", please.")).alias("user"), steps.alias("steps"))
    x = c.groupBy(F.col("conv_id").alias("plan_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    x = x.select("plan_id", F.transform(F.slice("t", 1, 6), lambda z: F.struct(z["user"].alias("user"), z["steps"].alias("steps"))).alias("turns"))
    return x.where(L.valid_plan(F.col("turns"))).select("plan_id", L.normalised_plan(F.col("turns")).alias("turns"))


@query("scenario_traces")
def scenario_traces(s, d):
    facts, memory = pools(s, d)
    sandbox = recorded(s, d).where("pattern = 'sandbox'").select("question", "tool", "arguments", "result")
    make = Z.Scenarios(scenario_plans(s, d), facts, memory, "2026-01-01T00:00:00", 7, sandbox, V.described(nation_symbols(s, d)))
    return C.filled(s, make.traces, as_many(s, d), max_len=16384)[0]


@query("block_grammar", "with b as (select conv_id, turn, text, (conv_id+turn)%3 as k from conversations where role='assistant') select conv_id, turn, k<>0 as valid, case when k=0 then 11 else -1 end as bad_at, case when k=0 then 'bad' else 'done' end as state from b")
def block_grammar(s, d):
    x = chat_bodies(s, d).select("conv_id", "turn", F.concat(F.lit("<assistant>"), "body", F.lit("</assistant>")).alias("block"))
    return H.block_verdicts(x, "block", ["calc", "now", "search_memory", "web_search", "finish"]).select("conv_id", "turn", "verdict.valid", F.coalesce("verdict.bad_at", F.lit(-1)).alias("bad_at"), "verdict.state")


@query("topic_counts", "with n as (select (length(text)-length(replace(text,'the','')))/3 as a, (length(text)-length(replace(text,'der','')))/3 as b, (length(text)-length(replace(text,'eau','')))/3 as c from documents), t as (select case when a>=b and a>=c then 'english' when b>=c then 'german' else 'french' end as topic from n) select v.topic, count(t.topic) as n from (values ('english'),('german'),('french')) v(topic) left join t using (topic) group by 1")
def topic_counts(s, d):
    return V.topic_counts(t(s, d, "documents"), "text", {"english": ["the"], "german": ["der"], "french": ["eau"]})


@query("total_loss", "with x as (select (vec_id%10)/10.0 as loss, ln(list_sum(list_transform(embedding, lambda e: exp(e::double)))) as z from embeddings) select round(avg(loss), 9) as loss, round(0.0001*avg(z*z), 9) as z_loss, round(avg(loss)+0.0001*avg(z*z), 9) as total from x")
def total_loss(s, d):
    x = t(s, d, "embeddings").select("embedding", ((F.col("vec_id") % 10) / 10.0).alias("loss"), F.lit(1.0).alias("mask"))
    return E.total_loss(x, "embedding", 0.0001).select(*[F.round(c, 9).alias(c) for c in ("loss", "z_loss", "total")])


@query("load_balance", "with x as (select vec_id, generate_subscripts(embedding,1)-1 as k, unnest(embedding)::double as v from embeddings), p as (select k, exp(v)/sum(exp(v)) over (partition by vec_id) as pr from x), u as (select k, avg(pr) as usage from p group by 1) select round(sum((usage-1/64)*(usage-1/64)), 12) as loss from u")
def load_balance(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    p = t(s, d, "embeddings").select(F.posexplode(K.softmax(v)).alias("k", "p"))
    return K.load_balance(p, "k", "p", 64).select(F.round("loss", 12).alias("loss"))


@query("nested_calls", "select conv_id, count(*) as n, string_agg('{\"a\":{\"b\":[' || turn || ',{\"c\":\"}\"}]}}', ';' order by turn) as arguments from conversations where role='assistant' group by 1")
def nested_calls(s, d):
    a = F.concat(F.lit('{"thought":"t","tool_call":{"name":"calc","arguments":{"a":{"b":['), F.col("turn").cast("string"), F.lit(',{"c":"}"}]}}}}'))
    x = t(s, d, "conversations").where("role = 'assistant'").withColumn("text", a)
    x = P.serialise(x).select("conv_id", P.tool_calls(F.col("trace")).alias("c"))
    return x.select("conv_id", F.size("c").cast("bigint").alias("n"), F.array_join(F.transform("c", lambda c: c["arguments"]), ";").alias("arguments"))


@query("published_parts", "select doc_id, source, n_chars from documents")
def published_parts(s, d):
    """Documents built into a dataset in four parts, published and read back."""
    x = t(s, d, "documents").select("doc_id", "source", "n_chars")
    return U.built(s, f"{scratch.folder(s)}/datasets", {"table": d, "run": uuid.uuid4().hex}, 4, lambda i: x.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == i))


@query("lookup_chains")
def lookup_chains(s, d):
    facts = t(s, d, "part").select(F.concat_ws(" ", F.lower("p_name"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.col("p_size").cast("string"), F.lit(" units")).alias("value"))
    return G.lookup_chains(s, as_many(s, d), facts.withColumn("number", N.first_number(F.col("value"))))


@query("tool_listing", "select lower(n_name) as name, '{\"type\":\"function\",\"function\":{\"name\":\"'||lower(n_name)||'\",\"description\":\"a nation\",\"parameters\":{\"type\":\"object\",\"properties\":{\"key\":{\"type\":\"string\"}},\"required\":[\"key\"]}}}' as row from nation")
def tool_listing(s, d):
    tools = t(s, d, "nation").select(F.lower("n_name").alias("name"), F.lit("a nation").alias("description"), F.array(F.lit("key")).alias("params"))
    return V.tool_listing(tools)
