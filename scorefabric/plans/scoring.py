"""Queries of the scoring run: clip features, selection, alignment, strata, stacks, comparison, attribution, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorefabric.functions import expressions as X
from scorefabric.functions import syntax
from scorefabric.operators import attribution, contracts, estimators, folds, models, sequences, similarity, stats
from scorefabric.operators.written import fresh_folder
from scorefabric.plans.queries import TOK_SQL, _views, query, r6, split_of, spread, t
from scorefabric.sources import readers, sinks

LIST = "list_transform(embedding, lambda x: x::double)"


def rounded(df, key: str, names: list[str] | None = None):
    return df.select(key, *[r6(F.col(c).cast("double")).alias(c) for c in names or [c for c in df.columns if c != key]])


# ---- clip features ----


@query("""with v as (select vec_id, list_transform(embedding, lambda x: 20*log10(abs(x::double)+1e-12)) l from embeddings), q as (select *, list_aggregate(l,'quantile_cont',0.9) p90, list_aggregate(l,'quantile_cont',0.5) p50, list_aggregate(l,'quantile_cont',0.1) p10 from v), a as (select *, list_filter(range(1,len(l)+1), lambda i: l[i]>greatest(p90-12,-55.0)) act from q), g as (select *, list_filter(list_transform(range(2,len(act)+1), lambda k: act[k]-act[k-1]-1), lambda r: r>=3) ps from a) select vec_id, round(p10,6) noise_floor_db, round(p50,6) median_db, round(p90,6) speech_level_db, round(p90-p10,6) dyn_range_db, round(len(act)::double/len(l),6) active_ratio, round(len(act)*0.125::double,6) active_sec, round(case when len(act)>0 then act[1]-1 else len(l) end*0.125::double,6) lead_sil, round(case when len(act)>0 then len(l)-act[len(act)] else len(l) end*0.125::double,6) trail_sil, len(ps)::double n_pauses, round(coalesce(list_sum(ps),0)*0.125::double,6) pause_total, round(coalesce(list_max(ps),0)*0.125::double,6) pause_max from g""")
def energy_activity(spark, d):
    """Coordinates taken as frame amplitudes of an eighth of a second."""
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: 20 * F.log10(F.abs(x.cast("double")) + 1e-12)).alias("l"))
    return rounded(X.unpacked(e, ["vec_id"], sequences.activity(F.col("l"), 0.125, 12.0, -55.0, 0.375)), "vec_id")


@query("""with f as (select vec_id, list_transform(embedding, lambda x: x::double) v, unnest(range(0, greatest(len(embedding)-16,0)//6+1)) i from embeddings) select vec_id, i::bigint i, round(20*log10(sqrt(coalesce(list_sum(list_transform(v[i*6+1:i*6+16], lambda x: x*x)),0)/16+1e-12)+1e-12),6) db from f""")
def frame_levels(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.posexplode(sequences.frames_of(F.col("embedding"), 16, 6)).alias("i", "db"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("db")).alias("db"))


@query("""select vec_id, i::bigint chunk, len(embedding[i*30+1:i*30+30])::bigint n, round(list_sum(list_transform(embedding[i*30+1:i*30+30], lambda x: x::double)),6) total from (select vec_id, embedding, unnest(range(0,greatest(ceil(len(embedding)/30.0)::bigint,1))) i from embeddings) where i=0 or len(embedding[i*30+1:i*30+30])>=5""")
def tumbling_chunks(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.posexplode(sequences.chunks(F.col("embedding"), 30, 5)).alias("chunk", "c"))
    return e.select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n"), r6(X.total(F.col("c"))).alias("total"))


@query(f"""with k as (select doc_id, n_chars/10.0::double dur, {TOK_SQL} w from documents where n_chars is not null), f as (select *, len(w) n, greatest(dur,1.0::double)/60 mi from k) select doc_id, n::double n_words, round(n/mi,6) wpm, case when n>0 then round(((n-1)//5)/mi,6) end pause50_per_min, case when n>1 then case when n>5 then 0.65 else 0.0 end when n=1 then 0.0 end::double pause_mean, case when n>0 then round(n/((n-1)//5+1),6) end mean_run_len, case when n>0 then least(n,5)::double end max_run_len, case when n>0 then round(list_sum(list_transform(w, lambda x: (length(x)%10)/10.0::double))/n,6) end word_prob_mean, case when n>0 then round(100.0::double*len(list_filter(w, lambda x: x in ('um','uh','er','ah','erm','hmm','mm','uhm','umm','uhh','eh','huh','hm')))/n,6) end filler_per100 from f""")
def timing_profile(spark, d):
    """Words spoken every 0.4 s for 0.35 s, with 0.6 s more after each fifth."""
    k = spread(t(spark, d, "documents").where("n_chars is not null").select("doc_id", "text", (F.col("n_chars") / 10).alias("dur")))
    at = lambda i: i * 0.4 + F.floor(i / 5) * 0.6
    words = F.transform(X.tokens(F.col("text")), lambda w, i: F.struct(at(i).alias("start"), (at(i) + 0.35).alias("end"), w.alias("word"), ((F.length(w) % 10) / 10).alias("prob")))
    f = X.unpacked(k.withColumn("words", words), ["doc_id"], X.timing_features(F.col("words"), F.col("dur")))
    return rounded(f, "doc_id", ["n_words", "wpm", "pause50_per_min", "pause_mean", "mean_run_len", "max_run_len", "word_prob_mean", "filler_per100"])


@query(f"""with k as (select doc_id, {TOK_SQL} w from documents), u as (select doc_id, unnest(w) w, generate_subscripts(w,1)-1 i from k), s as (select doc_id, i//12 s, count(*) filter (where regexp_full_match(w,'[a-z]+')) n, max(floor(log2(i%12+1))) deep from u group by all having count(*) filter (where regexp_full_match(w,'[a-z]+'))>0), a as (select doc_id, count(*) filter (where regexp_full_match(w,'[a-z]+')) n, count(*) filter (where length(w)%5=1) conj, count(*) filter (where length(w)%5=2 or length(w)%12=9) sconj, count(*) filter (where length(w)%5=3) passive, count(*) filter (where length(w)%5=4) clauses, count(*) filter (where regexp_full_match(w,'[a-z]+') and length(w)%12=0) noun, count(*) filter (where length(w)%8=2) vbg, count(distinct case when length(w)%8<7 then length(w)%8 end) div from u group by doc_id), b as (select doc_id, count(*) k, avg(n) m, stddev_pop(n) sd, max(n) mx, avg(deep) dm, max(deep) dx from s group by doc_id) select d.doc_id, coalesce(a.n,0)::double ling_n_words, k::double n_sents, round(m,6) sent_len_mean, round(sd,6) sent_len_std, mx::double sent_len_max, round(dm,6) dep_depth_mean, dx::double dep_depth_max, round(clauses::double/k,6) clauses_per_sent, round(conj::double/k,6) conj_per_sent, round(100.0::double*sconj/a.n,6) sconj_per_100, round(100.0::double*passive/a.n,6) passive_per_100, round(noun::double/a.n,6) "pos_NOUN", round(vbg::double/a.n,6) "vtag_VBG", case when a.n>0 then div end::double verb_form_diversity from documents d left join a using(doc_id) left join b using(doc_id)""")
def syntax_profile(spark, d):
    """Sentences of twelve words, heads at half a word's place, labels by length: a parse without a parser."""
    k = spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.tokens(F.col("text")).alias("w"))
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n)
    deps = ["nsubj", "conj", "mark", "nsubjpass", "advcl"]

    def word(w, i):
        p, n = i % 12 + 1, F.length(w)
        return F.struct(w.alias("word"), F.floor(i / 12).alias("sent"), pick(syntax.POS_KEYS, n % 12).alias("pos"), pick([*syntax.VERB_TAGS, "NN"], n % 8).alias("tag"), pick(deps, n % 5).alias("dep"), (i - i % 12 + F.greatest(F.floor(p / 2), F.lit(1))).cast("int").alias("head"))

    p = k.select("doc_id", F.transform("w", word).alias("parse"))
    f = X.unpacked(p, ["doc_id"], syntax.syntax_features(F.col("parse")))
    return rounded(f, "doc_id", ["ling_n_words", "n_sents", "sent_len_mean", "sent_len_std", "sent_len_max", "dep_depth_mean", "dep_depth_max", "clauses_per_sent", "conj_per_sent", "sconj_per_100", "passive_per_100", "pos_NOUN", "vtag_VBG", "verb_form_diversity"])


@query("""select event_id, greatest(round_even(value*2/10,0),4)::int stratum, (abs(value-45.06)<0.2)::int near_45, least(1500,ceil(value*160/16000.0::double*50))::int frames from events where value is not null""")
def grade_strata(spark, d):
    e = t(spark, d, "events").where("value is not null")
    return e.select("event_id", X.stratum(F.col("value") / 10).alias("stratum"), X.near_45(F.col("value")).alias("near_45"), X.frame_count(F.col("value") * 160).alias("frames"))


@query("""select event_id, least(375,ceil(least(30.0::double,value/4)*12.5))::int+least(375,greatest(ceil(least(30.0::double,greatest(value/4-30,0.0::double))*12.5),0))::int valid from events where value>=0""")
def valid_token_counts(spark, d):
    m = X.valid_tokens(F.col("value") / 4, 750)
    return t(spark, d, "events").where("value >= 0").select("event_id", F.size(F.filter(m, lambda x: x)).alias("valid"))


@query(f"""with v as (select vec_id, {LIST} v from embeddings), s as (select vec_id, v, list_sum(list_transform(v, lambda x: exp(x))) z from v) select vec_id, i::bigint i, round(exp(v[i])/z,6) p, round(v[i]-ln(z),6) log_p from (select *, unnest(range(1,len(v)+1)) i from s)""")
def softmax_rows(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    both = F.arrays_zip(X.softmax(F.col("v")).alias("p"), X.log_softmax(F.col("v")).alias("log_p"))
    return e.select("vec_id", F.posexplode(both).alias("i", "b")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("b.p")).alias("p"), r6(F.col("b.log_p")).alias("log_p"))


@query(r"""with w as (select item_id, text, regexp_split_to_array(trim(text),'\s+') w from benchmark where text is not null) select item_id, case when len(w)>160 then array_to_string(w[1:160],' ')||' ...' else array_to_string(w,' ') end short, regexp_replace(text||' Thank You for watching! ','(thanks|thank you) for watching!?\s*$','','i') closed, regexp_extract('language_model.model.layers.'||item_id||'.mlp','language_model\.model\.layers\.(\d+)\.',1)::int layer, 'Grade'||chr(10)||'Scale 1.0-5.0.'||chr(10)||chr(10)||'Text: a'||chr(10)||'Grade: 2.5'||chr(10)||chr(10)||'Text: '||text||chr(10)||'Grade:' prompt from w""")
def text_templates(spark, d):
    b = t(spark, d, "benchmark").where("text is not null")
    shot = F.array(F.struct(F.lit("a").alias("text"), F.lit(2.5).alias("grade")))
    return b.select("item_id", X.truncate_words(F.col("text")).alias("short"), X.strip_closing(F.concat("text", F.lit(" Thank You for watching! "))).alias("closed"), X.layer_of(F.concat(F.lit("language_model.model.layers."), "item_id", F.lit(".mlp"))).alias("layer"), similarity.few_shot_prompt(shot, F.col("text"), "Grade").alias("prompt"))


@query("""select user_id, round(avg(-value),6) avg_logprob_mean, min(-value) avg_logprob_min, max(value*2) compression_max, max(value/3) no_speech_max from events where value is not null group by user_id""")
def segment_profile(spark, d):
    s = t(spark, d, "events").where("value is not null").select("user_id", (-F.col("value")).alias("avg_logprob"), (F.col("value") * 2).alias("compression_ratio"), (F.col("value") / 3).alias("no_speech_prob"))
    f = s.groupBy("user_id").agg(*[c.alias(k) for k, c in X.segment_aggregates().items()])
    return f.withColumn("avg_logprob_mean", r6(F.col("avg_logprob_mean")))


@query("""select vec_id, i::bigint i, (case when x=0 then 0.0 else round_even(x/pow(2,greatest(floor(log2(abs(x))),-14)-10),0)*pow(2,greatest(floor(log2(abs(x))),-14)-10) end)::double h from (select vec_id, i, embedding[i]::double x from (select *, unnest(range(1,len(embedding)+1)) i from embeddings))""")
def half_floats(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return e.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), X.half(F.col("x")).alias("h"))


@query("""with f as (select vec_id//40 clip, vec_id%40 p, list_transform(embedding, lambda x: x::double) v from embeddings), s as (select clip, 10.0::double+(clip%7)*3 sec, p, v from f), k as (select clip, v from s where p%15 < least(15, ceil(least(12.0::double, greatest(sec-12.0::double*(p//15), 0.0::double))*1.25))), x as (select clip, v[i] e, i from (select *, unnest(range(1,len(v)+1)) i from k)) select clip, i::bigint i, count(*) n, round(avg(e),6) mean, round(stddev_pop(e),6) sd from x group by clip, i""")
def masked_pooling(spark, d):
    """Vectors as frame states, forty a clip: chunks of twelve seconds have fifteen frames, valid as far as the clip lasts."""
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("clip"), (F.col("vec_id") % 40).alias("p"), F.col("embedding").alias("v"))
    pooled = sequences.masked_pooled(e.withColumn("sec", 10 + (F.col("clip") % 7) * 3.0), ["clip"], "p", "sec", "v", 15, 12.0, 1.25)
    each = pooled.select("clip", "n", F.posexplode(F.arrays_zip("mean", "sd")).alias("i", "e"))
    return each.select("clip", (F.col("i") + 1).cast("long").alias("i"), "n", r6(F.col("e.mean")).alias("mean"), r6(F.col("e.sd")).alias("sd"))


@query("""with e as (select vec_id//5 clip, i, embedding[i]::double x from (select *, unnest(range(1,len(embedding)+1)) i from embeddings)), p as (select clip, i, avg(x) m, stddev_pop(x) s from e group by all), k as (select clip, unnest([0,1]) part, i, unnest([m,s]) v from p where (i-1)//8 between 3 and 6), z as (select clip, part, i, (v-avg(v) over (partition by part, i))/(stddev_pop(v) over (partition by part, i)+1e-8) z from k), n as (select clip, sqrt(sum(z*z)) l from z group by clip) select clip, (part*32+i-24)::bigint i, round(z/l,6) v from z join n using(clip)""")
def speaker_vectors(spark, d):
    """Clips of five vectors, each eight layers of eight: mean and deviation of layers 3 to 6."""
    e = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("clip"), "embedding")
    p = sequences.masked_pooled(e, ["clip"], None, None, "embedding")
    layers = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(c, k * 8 + 1, 8))
    v = similarity.speaker_vectors(p.select("clip", layers(F.col("mean")).alias("mean"), layers(F.col("sd")).alias("sd")), "clip", "mean", "sd")
    return v.select("clip", F.posexplode("vector").alias("i", "v")).select("clip", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("v")).alias("v"))


@query("""select vec_id, i::bigint i, 2*len(embedding)::bigint bytes, (case when x=0 then 0.0 else round_even(x/pow(2,greatest(floor(log2(abs(x))),-14)-10),0)*pow(2,greatest(floor(log2(abs(x))),-14)-10) end)::double h from (select vec_id, embedding, i, embedding[i]::double x from (select *, unnest(range(1,len(embedding)+1)) i from embeddings))""")
def packed_halves(spark, d):
    """Vectors as bytes of 16-bit floats and back."""
    p = sinks.packed_halves(t(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"]).withColumn("bytes", F.octet_length("embedding").cast("long"))
    e = sinks.unpacked_halves(p, ["embedding"])
    return e.select("vec_id", "bytes", F.posexplode("embedding").alias("i", "h")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), "bytes", F.col("h").cast("double").alias("h"))


@query("""select doc_id, case when n_chars%7=0 then null else lang end lang, case when n_chars%7=0 then null else round(1.0/(1+n_chars%9),6) end::double prob, case when n_chars%7=0 then null else least(n_chars%4,3) end::bigint others, case when n_chars%7=0 then 'too short' end error from documents""")
def language_records(spark, d):
    """Records of a language model: a language with its candidates, or an error in their place."""
    k = t(spark, d, "documents")
    other = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("x"), i.cast("string")).alias("code"), F.lit(0.1).alias("prob")))
    good = F.to_json(F.struct("lang", F.round(1 / (1 + F.col("n_chars") % 9), 6).alias("prob"), F.slice(other, F.lit(1), F.least(F.col("n_chars") % 4, F.lit(3)).cast("int")).alias("top5")))
    record = F.when(F.col("n_chars") % 7 == 0, F.lit('{"error": "too short"}')).otherwise(good)
    return readers.language_ids(k.select("doc_id", record.alias("record")), "record").select("doc_id", "lang", "prob", F.when(F.col("error").isNull(), F.size("top5")).cast("long").alias("others"), "error")


# ---- files ----


@query("select o_orderkey, o_custkey, o_totalprice, 'train' split, null::double label from orders")
def csv_source(spark, d):
    """Orders written as CSV, read by a declared schema with a split's name, and with a label that the file lacks."""
    at = fresh_folder(spark, "csv")
    sinks.to_csv(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), at)
    read = readers.csv_clips(spark, at, "train", "o_orderkey long, o_custkey long, o_totalprice double")
    return readers.union_clips([read, spark.createDataFrame([], "label double")])


@query("select split, filename, text, 0.5::double first_end, langid from (select lang split, doc_id::varchar filename, text, source langid from documents where text is not null)")
def jsonl_source(spark, d):
    """Documents appended as JSON lines in two goes, read by the schema of a transcript; keys that no record has are null."""
    at = fresh_folder(spark, "jsonl")
    docs = t(spark, d, "documents").where("text is not null")
    rows = docs.select(F.col("lang").alias("split"), F.col("doc_id").cast("string").alias("filename"), "text", F.struct(F.col("source").alias("lang")).alias("langid"), F.array(F.array(F.lit("0.0"), F.lit("0.5"), F.lit("w"), F.lit("0.9"))).alias("words"))
    for half in (0, 1):
        sinks.to_jsonl(rows.where(F.pmod(F.xxhash64("filename"), F.lit(2)) == half), at)
    read = readers.jsonl_asr(spark, at)
    return read.where("duration is null and segments is null").select("split", "filename", "text", F.col("words")[0]["end"].alias("first_end"), F.col("langid.lang").alias("langid"))


@query("select lang, source, count(*) n from documents where doc_id%5=0 or doc_id not in (select doc_id from labels where toxic=1) group by all")
def usable_rows(spark, d):
    """Rows of the test split, and of the others those not known to be noise."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("noisy")).distinct(), "doc_id", "left")
    kept = docs.where(X.usable(split_of("doc_id"), F.col("noisy")))
    return X.dropped(kept, ["text", "n_chars", "absent"], missing_ok=True).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("select d.doc_id, case when lang<>'en' then 'other language' when quality=0 then 'label 0' else 'short' end why from documents d left join labels l using(doc_id) where lang<>'en' or quality=0 or n_chars<400")
def diagnostic_rows(spark, d):
    """Rows to look at: another language, a label of 0, or little text."""
    k = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    why = F.when(F.col("lang") != "en", "other language").when(F.col("quality") == 0, "label 0").when(F.col("n_chars") < 400, "short")
    return k.select("doc_id", why.alias("why")).where("why is not null")


# ---- selection, order, sets ----


def _permuted_sql(seed: int, rounds: int) -> str:
    keys = ", ".join(f"[{a}, {b}, {c}]" for a, b, c in folds.round_keys(seed, rounds))
    return f"with c as (select c_custkey, row_number() over (order by c_custkey)-1 x, count(*) over () n from customer) select c_custkey, list_reduce(list_prepend([x, n, 0], [{keys}]), lambda acc, k: [case when ((greatest(acc[1], ((k[1] % acc[2]) + acc[2] - acc[1]) % acc[2]) % 2147483647 * k[2] + k[3]) % 2147483647) // 32768 % 2 = 1 then ((k[1] % acc[2]) + acc[2] - acc[1]) % acc[2] else acc[1] end, acc[2], 0])[1]::bigint place from c"


@query(_permuted_sql(42, 24))
def seeded_permutation(spark, d):
    """Every customer once, at a place that the seed decides."""
    c = folds.numbered(t(spark, d, "customer").select("c_custkey"), "c_custkey", "x")
    return c.select("c_custkey", folds.permuted(F.col("x"), c.count(), 42, 24).alias("place"))


@query("select l_returnflag, round(avg(l_quantity),6) l_quantity, round(avg(l_extendedprice),6) l_extendedprice, round(avg(l_discount),6) l_discount, round(avg(l_tax),6) l_tax from lineitem group by l_returnflag")
def selected_columns(spark, d):
    """Means of numeric columns chosen by prefix, without keys and without a deny-list."""
    li = t(spark, d, "lineitem")
    names = X.numeric_columns(li, prefix=("l_",), deny=("l_linenumber",), exclude=("key",))
    return li.groupBy("l_returnflag").agg(*[r6(F.avg(c)).alias(c) for c in names])


@query("select * from (select c_custkey, c_acctbal-4500 shifted from customer order by abs(c_acctbal-4500) desc, c_custkey limit 20)")
def largest_by_magnitude(spark, d):
    c = t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") - 4500).alias("shifted"))
    return c.orderBy(F.abs("shifted").desc(), "c_custkey").limit(20)


@query("with c as (select user_id, event_type, count(*) n from events group by all), s as (select user_id, event_type, n::double/sum(n) over (partition by user_id) p from c) select user_id, string_agg(event_type||'='||round(p,4)::varchar, ' ' order by p desc, event_type) top from (select *, row_number() over (partition by user_id order by p desc, event_type) k from s) where k<=5 group by user_id")
def top_candidates(spark, d):
    n = t(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("code"), F.col("count").cast("double").alias("n"))).alias("c"), F.sum("count").alias("all"))
    top = X.top_candidates(F.col("c"), "n")
    return n.select("user_id", F.array_join(F.transform(top, lambda x: F.concat(x["code"], F.lit("="), F.round(x["n"] / F.col("all"), 4).cast("string"))), " ").alias("top"))


@query("select lang, string_agg(source||'='||n, ' ' order by source) counts from (select lang, source, count(*) n from documents where source is not null group by all) group by lang")
def count_maps(spark, d):
    m = stats.count_maps(t(spark, d, "documents"), "lang", "source")
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("lang", F.array_join(entries, " ").alias("counts"))


@query("""select event_id, '{"event_id":'||event_id||',"user":{"id":'||user_id||',"type":"'||event_type||'"}}' record from events where user_id is not null and event_type is not null""")
def json_records(spark, d):
    e = t(spark, d, "events").where("user_id is not null and event_type is not null")
    return e.select("event_id", F.to_json(F.struct("event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("type")).alias("user"))).alias("record"))


# ---- alignment, strata, folds ----


@query("select l.doc_id, d.n_chars, d.source from labels l join documents d using(doc_id)")
def aligned_rows(spark, d):
    return contracts.aligned(t(spark, d, "labels").select("doc_id"), t(spark, d, "documents").select("doc_id", "n_chars", "source"), ["doc_id"])


@query("select d.doc_id, case when d.lang='en' then 0.0 else coalesce(l.quality/2.0::double,0.0) end::double pred from documents d left join labels l using(doc_id)")
def masked_override(spark, d):
    docs, lab = t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels")
    s = contracts.scattered(docs, lab.select("doc_id", (F.col("quality") / 2).alias("pred")), ["doc_id"], "pred")
    return s.select("doc_id", X.overridden(F.col("pred"), F.col("lang") == "en").alias("pred"))


@query("with k as (select p_partkey, p_size||'_'||p_brand s from part), c as (select s, count(*) n from k group by s) select p_partkey, case when n<5 then 'rare' else s end stratum from k join c using(s)")
def rare_strata(spark, d):
    return folds.crossed_strata(t(spark, d, "part"), ["p_size", "p_brand"]).select("p_partkey", "stratum")


@query("with s as (select p_retailprice, row_number() over (order by p_retailprice desc nulls last) r from part) select shard, count(*) n, round(sum(p_retailprice),2) load, max(p_retailprice) largest from (select *, ((r-1)%8)::int shard from s) group by shard")
def lpt_shard_sizes(spark, d):
    """The load of each shard, which no other numbering gives: rows of equal price are alike here."""
    p = t(spark, d, "part").select("p_partkey", "p_retailprice")
    return folds.lpt_shards(p, "p_partkey", "p_retailprice", 8).join(p, "p_partkey").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("load"), F.max("p_retailprice").alias("largest"))


# ---- contracts ----


@query("select c_custkey o_custkey, 'b' side from customer where c_custkey not in (select o_custkey from orders) union select o_custkey, 'a' from orders where o_custkey not in (select c_custkey from customer)")
def contract_coverage(spark, d):
    return contracts.uncovered(t(spark, d, "orders").select("o_custkey"), t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("select event_id from events where value is null or isnan(value) or isinf(value) or user_id%97=0")
def contract_finite(spark, d):
    e = t(spark, d, "events").withColumn("value", F.when(F.col("user_id") % 97 != 0, F.col("value")))
    return contracts.not_finite(e, ["value"]).select("event_id")


@query("select l_orderkey, l_linenumber from lineitem where not (abs(l_extendedprice-round(l_extendedprice,1))<=1e-8+1e-7*abs(round(l_extendedprice,1)))")
def contract_equal_labels(spark, d):
    return contracts.unequal(t(spark, d, "lineitem").withColumn("b", F.round("l_extendedprice", 1)), "l_extendedprice", "b", 1e-7).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, count(*) as count from lineitem group by 1 having count(*)<>4")
def contract_repeats(spark, d):
    return contracts.miscounted(t(spark, d, "lineitem"), ["l_orderkey"], 4)


@query("select l.doc_id, l.quality quality_old, l.quality+1 quality_new from labels l")
def one_to_one_join(spark, d):
    lab = t(spark, d, "labels").select("doc_id", "quality")
    return contracts.join_one_to_one(lab, lab.withColumn("quality", F.col("quality") + 1), ["doc_id"])


# ---- models ----

STACK_SQL = "(select o_orderkey id, o_custkey%50 g, o_totalprice/100000*0.9::double+(o_orderkey%7)/10.0::double y, o_totalprice/100000+(o_orderkey%11)/10.0::double m1, (o_custkey%13)/4.0::double m2 from orders)"


def _weights_sql(by: str, source: str) -> str:
    """Non-negative weights of m1 and m2 in closed form: the best of both, one and none that has no negative weight."""
    return f"""(select *, my-w1*mm1-w2*mm2 b from (select *, case when det>0 and v1*c22-v2*c12>0 and v2*c11-v1*c12>0 then (v1*c22-v2*c12)/det when greatest(v1,0)*v1/c11>=greatest(v2,0)*v2/c22 then greatest(v1,0)/c11 else 0 end w1, case when det>0 and v1*c22-v2*c12>0 and v2*c11-v1*c12>0 then (v2*c11-v1*c12)/det when greatest(v1,0)*v1/c11>=greatest(v2,0)*v2/c22 then 0 else greatest(v2,0)/c22 end w2 from (select *, c11*c22-c12*c12 det from (select {by} covar_pop(m1,m1) c11, covar_pop(m1,m2) c12, covar_pop(m2,m2) c22, covar_pop(m1,y) v1, covar_pop(m2,y) v2, avg(m1) mm1, avg(m2) mm2, avg(y) my from {source}))))"""


def _two(spark, d):
    price = F.col("o_totalprice") / 100000
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("g"), (price * 0.9 + (F.col("o_orderkey") % 7) / 10).alias("y"), (price + (F.col("o_orderkey") % 11) / 10).alias("m1"), ((F.col("o_custkey") % 13) / 4).alias("m2"))


@query(f"with w as {_weights_sql('', STACK_SQL)} select unnest(['m1','m2','intercept']) model, round(unnest([w1,w2,b]),6) weight from w")
def nnls_two(spark, d):
    w, b = models.fit_stack(_two(spark, d), ["m1", "m2"], "y")
    return spark.createDataFrame([(k, round(x, 6)) for k, x in [*w.items(), ("intercept", b)]], "model string, weight double")


@query(f"""with s as {STACK_SQL}, f as (select g, r.repeat, (('0x'||substr(md5((42+r.repeat)||':'||g),1,8))::bigint%5)::int fold from (select distinct g from s) q, (select unnest([0,1]) repeat) r), p as (select s.*, repeat, fold from s join f using(g)), c as (select a.fold ff, p.* from p join (select distinct repeat, fold from f) a on a.repeat=p.repeat and a.fold<>p.fold), w as {_weights_sql("repeat, ff,", "c group by repeat, ff")}, o as (select id, any_value(y) y, avg(b+w1*m1+w2*m2) m from p join w on w.repeat=p.repeat and w.ff=p.fold group by id) select id, y, round(greatest(least(m,5.0),1.0),6) stack_oof from o""")
def nested_stack_two(spark, d):
    s = _two(spark, d)
    out = models.nested_stack(s, folds.hash_folds(s, "g", 5, 2), ["m1", "m2"], "y", "g", "id")
    return out.select("id", "y", r6(F.col("stack_oof")).alias("stack_oof"))


FOLD_SQL = "(('0x'||substr(md5(({seed}+r.repeat)||':'||g),1,8))::bigint%5)::int"
WITH_STATUS = STACK_SQL.replace("o_custkey%50 g", "o_custkey g, o_orderstatus h")


def _with_status(spark, d):
    """Customers as groups, an order's status as cohort."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("_g"), F.col("o_orderstatus").alias("h"))
    return _two(spark, d).join(o, "id").withColumn("g", F.col("_g")).drop("_g")


@query(f"""with s as {WITH_STATUS}, f as (select g, r.repeat, {FOLD_SQL.format(seed=42)} fold from (select distinct g from s) q, (select unnest([0,1]) repeat) r), p as (select s.*, repeat, fold from s join f using(g)), c as (select a.fold ff, p.* from p join (select distinct repeat, fold from f) a on a.repeat=p.repeat and a.fold<>p.fold), w as {_weights_sql("repeat, ff,", "c group by repeat, ff")}, l as (select c.repeat, c.ff, h, count(*) n, regr_slope(y, b+w1*m1+w2*m2) s, regr_intercept(y, b+w1*m1+w2*m2) i from c join w on c.repeat=w.repeat and c.ff=w.ff group by all), o as (select id, any_value(y) y, avg(case when l.n>20 then l.s*(b+w1*m1+w2*m2)+l.i else b+w1*m1+w2*m2 end) m from p join w on w.repeat=p.repeat and w.ff=p.fold left join l on l.repeat=p.repeat and l.ff=p.fold and l.h is not distinct from p.h group by id) select id, y, round(greatest(least(m,5.0),1.0),6) stack_oof from o""")
def calibrated_stack(spark, d):
    s = _with_status(spark, d)
    out = models.calibrated_stack(s, folds.hash_folds(s, "g", 5, 2), ["m1", "m2"], "y", "g", "id", "h")
    return out.select("id", "y", r6(F.col("stack_oof")).alias("stack_oof"))


def _ablation_sql() -> str:
    """Predictions of both stacks for three seeds, from closed-form weights."""
    parts, names = [f"s as {WITH_STATUS}"], []
    for k in (42, 142, 242):
        parts += [
            f"f{k} as (select g, r.repeat, {FOLD_SQL.format(seed=k)} fold from (select distinct g from s) q, (select 0 repeat) r)",
            f"p{k} as (select s.*, repeat, fold from s join f{k} using(g))",
            f"c{k} as (select a.fold ff, p.* from p{k} p join (select distinct repeat, fold from f{k}) a on a.fold<>p.fold)",
            f"w{k} as {_weights_sql('ff,', f'c{k} group by ff')}",
            f"v{k} as (select ff, v, my-v*mm v0 from (select ff, avg(m2) mm, avg(y) my, greatest(covar_pop(m2,y)/covar_pop(m2,m2),0) v from c{k} group by ff))",
            f"o{k} as (select id, y, g, greatest(least(b+w1*m1+w2*m2,5.0),1.0) f, greatest(least(v0+v*m2,5.0),1.0) w from p{k} p join w{k} w on w.ff=p.fold join v{k} v on v.ff=p.fold)",
        ]
        names.append(f"select * from o{k}")
    return f"with {', '.join(parts)} select id, any_value(y) y, any_value(g) g, round(avg(f),6) whole, round(avg(w),6) alone from ({' union all '.join(names)}) group by id"


def _ablated(spark, d):
    s = _with_status(spark, d)
    return models.ablation(s, [folds.hash_folds(s, "g", 5, 1, k) for k in (42, 142, 242)], ["m1", "m2"], ["m1"], "y", "g", "id")


@query(_ablation_sql())
def ablation_predictions(spark, d):
    return _ablated(spark, d).select("id", "y", "g", r6(F.col("full")).alias("whole"), r6(F.col("without")).alias("alone"))


@query()
def ablation_report(spark, d):
    return models.ablation_report(_ablated(spark, d), "y", "g")


@query(f"select unnest(['m1','m2']) model, unnest([0.7,0.3]::double[]) weight, round(unnest([stddev_pop(m1*0.7::double),stddev_pop(m2*0.3::double)]),6) spread from {STACK_SQL}")
def component_spread(spark, d):
    return models.component_spread(_two(spark, d), {"m1": 0.7, "m2": 0.3}).withColumn("spread", r6(F.col("spread")))


@query("""with m as (select count(*) n, avg(l_quantity) mx, stddev_pop(l_quantity) sx, avg(l_extendedprice) my, covar_pop(l_quantity,l_extendedprice) c from lineitem), a as (select unnest(list_transform(range(0,30), lambda i: pow(10.0::double,-2+i*5/29.0::double))) alpha), e as (select alpha, (l_extendedprice-my-((l_quantity-mx)/sx)*(n*c/sx)/(n+alpha))/(1-1.0::double/n-((l_quantity-mx)/sx)*((l_quantity-mx)/sx)/(n+alpha)) r from lineitem, m, a) select round(alpha,9) alpha, round(avg(r*r)/1e6,6) loo_mse from e group by alpha""")
def ridge_alpha_search(spark, d):
    out = models.ridge_search(t(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return out.select(F.round("alpha", 9).alias("alpha"), r6(F.col("loo_mse") / 1e6).alias("loo_mse"))


TREE = {"feature": 0, "threshold": 25.0, "cover": 100.0, "left": {"feature": 1, "threshold": 0.05, "cover": 50.0, "left": {"value": 1.0, "cover": 30.0}, "right": {"value": 3.0, "cover": 20.0}}, "right": {"value": 10.0, "cover": 50.0}}
TREE_SQL = "(select l_orderkey, l_linenumber, l_quantity q, l_discount d, 0.5*((case when l_quantity<=25 then 1.8 else 10 end-5.9)+((case when l_quantity>25 then 10 when l_discount<=0.05 then 1 else 3 end)-(0.5*case when l_discount<=0.05 then 1 else 3 end+5))) fq, 0.5*(((0.5*case when l_discount<=0.05 then 1 else 3 end+5)-5.9)+((case when l_quantity>25 then 10 when l_discount<=0.05 then 1 else 3 end)-case when l_quantity<=25 then 1.8 else 10 end)) fd from lineitem)"


def _parts(spark, d):
    return attribution.contributions(t(spark, d, "lineitem"), attribution.leaves(TREE), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@query(f"select l_orderkey, l_linenumber, unnest(['l_quantity','l_discount']) feature, round(unnest([fq,fd])::double,6) contribution from {TREE_SQL}")
def tree_contributions(spark, d):
    return _parts(spark, d).select("l_orderkey", "l_linenumber", "feature", r6(F.col("contribution")).alias("contribution"))


@query(f"""with c as (select unnest(['l_quantity','l_discount']) feature, unnest([q,d]) x, unnest([round(fq::double,9),round(fd::double,9)]) f from {TREE_SQL}), r as (select feature, f, rank() over (partition by feature order by x)+(count(*) over (partition by feature, x)-1)/2 a, rank() over (partition by feature order by f)+(count(*) over (partition by feature, f)-1)/2 b from c) select feature, round(avg(abs(f)),6) strength, sign(corr(a,b))::double sign from r group by feature""")
def tree_importance(spark, d):
    return attribution.importance(_parts(spark, d)).withColumn("strength", r6(F.col("strength")))


def _one_driver(spark, d, estimator):
    """Out-of-fold means, the refit's predictions and the largest figure of a row's fits, over both bands of the vectors."""
    v, f = _views(spark, d)
    p = estimators.predictions(v, f, "vec_id", "vec", "y", "g", estimator)
    s = estimators.summarised(p, v, "vec_id", "y")
    return s.select("view", "vec_id", "y", r6(F.col("pred")).alias("pred"), r6(F.col("full")).alias("full"), "n", "figure")


@query()
def ridge_refit(spark, d):
    return _one_driver(spark, d, estimators.Ridge()).withColumnRenamed("figure", "alpha")


#: Rows of a fit that a round of support vectors moves, in views too large for one kernel.
WORKING = 4096


@query()
def support_vectors(spark, d):
    return _one_driver(spark, d, estimators.Support(working=WORKING)).withColumnRenamed("figure", "kkt_residual")


@query()
def leafwise_trees(spark, d):
    return _one_driver(spark, d, estimators.Trees()).withColumnRenamed("figure", "leaves")


@query("""select unnest([1,2])::bigint component, round(unnest([1+abs(r),1-abs(r)]),6) variance, round(unnest([1+abs(r),1-abs(r)])/2,6) share from (select corr(l_quantity, l_extendedprice) r from lineitem)""")
def principal_components(spark, d):
    li = t(spark, d, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("x"))
    _, scale, _, variance = models.principal(li, "x")
    return spark.createDataFrame([(k + 1, round(float(v), 6), round(float(v) / len(scale), 6)) for k, v in enumerate(variance)], "component long, variance double, share double")


@query("select l_returnflag, m1, m2 from (select l_returnflag, round(avg(l_quantity),6) m1, round(avg(l_discount),6) m2 from lineitem group by 1)")
def oof_wide(spark, d):
    """Fold predictions of two models averaged by key, then side by side."""
    li = t(spark, d, "lineitem")
    long = li.select("l_returnflag", F.lit("m1").alias("model"), F.col("l_quantity").alias("pred")).union(li.select("l_returnflag", F.lit("m2"), F.col("l_discount")))
    return models.wide(models.oof_mean(long, ["l_returnflag"]), ["l_returnflag"], ["m1", "m2"]).select("l_returnflag", r6(F.col("m1")).alias("m1"), r6(F.col("m2")).alias("m2"))


# ---- bootstrap ----


def _poisson_sql() -> str:
    acc, term, out = 0.0, 0.36787944117144233, []
    for k in range(1, 9):
        acc += term
        term /= k
        out.append(f"(u>={acc!r}::double)::int")
    return "+".join(out)


def _draws_sql(n: int) -> str:
    return f"""s as (select g, y, m2 a, m1 b from {STACK_SQL}), q as (select g, count(*) k, sum(y) sy, sum(y*y) syy, sum((a-y)*(a-y)) sea, sum(a) sa, sum(a*a) saa, sum(y*a) sya, sum((b-y)*(b-y)) seb, sum(b) sb, sum(b*b) sbb, sum(y*b) syb from s group by g), dr as (select unnest(range(0,{n})) draw), w as (select *, {_poisson_sql()} w from (select draw, q.*, ('0x'||substr(md5('0:'||draw||':'||g),1,8))::bigint/4294967296.0::double u from q, dr)), t as (select draw, sum(w*k) k, sum(w*sy) sy, sum(w*syy) syy, sum(w*sea) sea, sum(w*sa) sa, sum(w*saa) saa, sum(w*sya) sya, sum(w*seb) seb, sum(w*sb) sb, sum(w*sbb) sbb, sum(w*syb) syb from w where w>0 group by draw), r as (select draw, sqrt(sea/k) ra, sqrt(seb/k) rb, (k*sya-sy*sa)/sqrt((k*syy-sy*sy)*(k*saa-sa*sa)) ca, (k*syb-sy*sb)/sqrt((k*syy-sy*sy)*(k*sbb-sb*sb)) cb from t)"""


def _ab(spark, d):
    return _two(spark, d).select("id", "g", "y", F.col("m2").alias("a"), F.col("m1").alias("b"))


@query(f"with {_draws_sql(1000)}, l as (select 'a' model, ra e, ca c from r union all select 'b', rb, cb from r) select model, round(stddev_pop(e),6) se_rmse, round(quantile_cont(e,0.025),6) rmse_low, round(quantile_cont(e,0.975),6) rmse_high, round(stddev_pop(c),6) se_r, round(stddev_pop((e+1-c)/2),6) se_composite from l group by model")
def bootstrap_errors(spark, d):
    out = stats.bootstrap_summary(stats.bootstrap(_ab(spark, d), "g", "y", ["a", "b"], 1000))
    return out.select("model", *[r6(F.col(c)).alias(c) for c in out.columns if c != "model"])


@query(f"with {_draws_sql(2000)}, x as (select rb-ra e, cb-ca c, (rb+1-cb)/2-(ra+1-ca)/2 p from r), m as (select count(*) n, sqrt(avg((a-y)*(a-y))) ra, sqrt(avg((b-y)*(b-y))) rb, corr(y,a) ca, corr(y,b) cb from s) select n, round(ra,6) old_rmse, round(rb,6) new_rmse, round(ca,6) old_r, round(cb,6) new_r, round((ra+1-ca)/2,6) old_composite, round((rb+1-cb)/2,6) new_composite, (select round(quantile_cont(e,0.025),6) from x) rmse_low, (select round(quantile_cont(e,0.975),6) from x) rmse_high, (select avg((e<0)::int) from x) p_better_rmse, (select avg((p<0)::int) from x) p_better_composite from m")
def run_comparison(spark, d):
    s = _ab(spark, d)
    c = models.compared(s.select("id", "g", "y", F.col("a").alias("pred")), s.select("id", F.col("b").alias("pred")), ["id"], "y", "g")
    ci = F.col("rmse_ci")
    return c.select(F.col("old_n").alias("n"), *[r6(F.col(f"{s_}_{m}")).alias(f"{s_}_{m}") for m in ("rmse", "r", "composite") for s_ in ("old", "new")], r6(ci[0]).alias("rmse_low"), r6(ci[1]).alias("rmse_high"), "p_better_rmse", "p_better_composite")
