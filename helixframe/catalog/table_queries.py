"""Queries and SQL of tabular reports, preparation, relational helpers, sources and sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.catalog.base import NUMBERS, PART, load, mixed, query, r6, seqs
from helixframe.catalog.oracles import SEQS
from helixframe.functions import sequence as S
from helixframe.operators import information, metrics, prep, profile, relational, validation
from helixframe.sources import readers, sinks
from helixframe.storage import new_path

ORACLES: dict[str, str] = {}


# Reports and rules.
def gaps(spark, d) -> DataFrame:
    """customer with nulls: balances at every third key, segments at every fifth."""
    c = load(spark, d, "customer")
    return c.select(
        "c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment")
    )


GAPS = "g as (select c_custkey, c_nationkey, case when c_custkey % 3 <> 0 then c_acctbal end as c_acctbal, case when c_custkey % 5 <> 0 then c_mktsegment end as c_mktsegment from customer)"


@query
def missing_metadata(spark, d):
    return validation.missing_metadata(gaps(spark, d)).select("field", "missing", r6(F.col("percentage"), "percentage"))


ORACLES["missing_metadata"] = f"""with {GAPS}, m as ({' union all '.join(f"select '{c}' as field, count(*) filter ({c} is null or {z}) as missing, round(count(*) filter ({c} is null or {z}) * 100.0::double / count(*), 6) as percentage from g"
for c, z in (('c_custkey', 'c_custkey = 0'), ('c_nationkey', 'c_nationkey = 0'), ('c_acctbal', 'c_acctbal = 0'), ('c_mktsegment', "c_mktsegment = ''")))}) select * from m where missing > 0"""


@query
def analysis_advice(spark, d):
    return validation.analysis_advice(gaps(spark, d))


def _far(c: str) -> str:
    return f"(select (count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count({c}) > 5)::int from g, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from g))"


ORACLES["analysis_advice"] = f"""with {GAPS}, s as (select count(*) as n, (count(*) filter (c_acctbal is null) + count(*) filter (c_mktsegment is null)) * 100.0 / count(*) / 2 as m, {_far('c_custkey')} + {_far('c_nationkey')} + {_far('c_acctbal')} as o from g),
r as (select [case when m > 20 then 'High percentage of missing data detected - consider imputation or removal' when m > 5 then 'Some missing data present - review data collection process' else 'Missing data is minimal and manageable' end,
case when o > 0 then 'Significant outliers detected in ' || o || ' columns - consider outlier treatment' end, case when n < 1000 then 'Small dataset size - consider data augmentation or collecting more samples'
when n > 100000 then 'Large dataset - consider sampling for faster prototyping' end] as all_ from s), f as (select list_filter(all_, lambda x: x is not null) as a from r)
select unnest(range(0, len(a)))::int as position, unnest(a) as recommendation from f"""


@query
def quality_advice(spark, d):
    return validation.quality_advice(gaps(spark, d).drop("c_custkey"))


ORACLES["quality_advice"] = f"""with {GAPS}, s as (select count(*) as n, count(*) filter (c_acctbal is null) + count(*) filter (c_mktsegment is null) as m from g), d as (select sum(n - 1)::bigint as dup from (select count(*) as n from g group by c_nationkey, c_acctbal, c_mktsegment)),
r as (select [case when m * 100.0 / (n * 3) > 10 then 'Consider handling missing values (>10% missing data detected)' end, case when dup > 0 then 'Remove ' || dup || ' duplicate rows' end] as all_ from s, d),
f as (select list_filter(all_, lambda x: x is not null) as a from r) select unnest(range(0, len(a)))::int as position, unnest(a) as recommendation from f"""


@query
def preprocessing_suggestions(spark, d):
    return validation.preprocessing_suggestions(gaps(spark, d).withColumn("sequence", F.lit("ACGT")))


ORACLES["preprocessing_suggestions"] = """select * from (values ('recommended', 'handle_missing_values'), ('recommended', 'feature_scaling'), ('optional', 'outlier_removal'), ('recommended', 'biological_features')) as t(kind, name)"""


@query
def missing_rollup(spark, d):
    return validation.missing_rollup(gaps(spark, d)).select("missing", r6(F.col("missing_percent"), "missing_percent"), "most_distinct")


ORACLES["missing_rollup"] = f"""with {GAPS} select count(*) filter (c_acctbal is null) + count(*) filter (c_mktsegment is null) as missing,
round((count(*) filter (c_acctbal is null) + count(*) filter (c_mktsegment is null)) * 100.0::double / count(*), 6) as missing_percent, greatest(count(distinct c_custkey), count(distinct c_acctbal)) as most_distinct from g"""


@query
def columns_overview(spark, d):
    return validation.columns_overview(gaps(spark, d))


ORACLES["columns_overview"] = f"""with {GAPS} select unnest(['c_custkey', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as "column", unnest([0, 0, count(*) filter (c_acctbal is null), count(*) filter (c_mktsegment is null)]) as missing,
unnest(['bigint', 'int', 'double', 'string']) as kind from g"""


@query
def outlier_samples(spark, d):
    return profile.outlier_samples(load(spark, d, "events"), "value", "event_id", 10)


ORACLES["outlier_samples"] = """with b as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
select event_id, value from events, b where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) order by event_id limit 10"""


@query
def label_distribution(spark, d):
    return load(spark, d, "labels").transform(lambda x: profile.value_counts(x, "quality"))


ORACLES["label_distribution"] = "select quality as value, count(*) as n from labels group by quality"


@query
def length_extremes(spark, d):
    return profile.length_profile(load(spark, d, "pages"), "html")


ORACLES["length_extremes"] = "select count(*) as rows, min(len(html)) as min, max(len(html)) as max, round(avg(len(html)), 6) as mean from pages"


@query
def null_matrix(spark, d):
    """Which cells of the first 100 rows by key are null; the sample is the plot's feature."""
    g = gaps(spark, d).orderBy("c_custkey").limit(100)
    return g.select("c_custkey", *[F.col(c).isNull().alias(f"{c}_null") for c in ("c_acctbal", "c_mktsegment")])


ORACLES["null_matrix"] = f"with {GAPS} select c_custkey, c_acctbal is null as c_acctbal_null, c_mktsegment is null as c_mktsegment_null from g order by c_custkey limit 100"


# Relational helpers.
@query
def point_lookup(spark, d):
    o = load(spark, d, "orders")
    return relational.lookup(o, "o_orderkey", 7, F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "F").unionByName(
        relational.lookup(o, "o_orderkey", 6, F.lit(True), F.lit(False))
    ).select("o_orderkey", "o_custkey")


ORACLES["point_lookup"] = "select o_orderkey, o_custkey from orders where o_orderkey = 7 and (o_custkey % 2 = 0 or o_orderstatus = 'F') union all select o_orderkey, o_custkey from orders where o_orderkey = 6"


@query
def preview(spark, d):
    return relational.preview(gaps(spark, d), "c_custkey", 20)


ORACLES["preview"] = f"with {GAPS} select c_custkey, c_nationkey, coalesce(c_acctbal, 0) as c_acctbal, c_mktsegment from g order by c_custkey limit 20"


@query
def substring_search(spark, d):
    return relational.search(load(spark, d, "part"), "Brand#1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


ORACLES["substring_search"] = "select p_partkey from part where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1') or contains(lower(p_type), 'brand#1')"


@query
def class_from_id(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 4 == 0, "12").otherwise(F.col("c_mktsegment")), F.lit("_7"), F.col("c_custkey")).alias("id"))
    return relational.class_of(c, "id").select("c_custkey", "class")


ORACLES["class_from_id"] = """with c as (select c_custkey, case when c_custkey % 4 = 0 then '12' else c_mktsegment end || '_7' || c_custkey as id from customer)
select c_custkey, case when regexp_extract(id, '([a-zA-Z_]+)', 1) = '' then 'unknown' else regexp_extract(id, '([a-zA-Z_]+)', 1) end as class from c"""


@query
def fastest(spark, d):
    return relational.fastest(load(spark, d, "orders"), "o_orderkey", "o_totalprice")


ORACLES["fastest"] = "select o_orderkey as fastest, o_totalprice as least from orders order by o_totalprice, o_orderkey limit 1"


@query
def top_importances(spark, d):
    p = load(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "kmer_").otherwise("x_"), F.col("p_partkey")).alias("feature"), F.col("p_retailprice").alias("importance"))
    return relational.top_importances(p, 15, "kmer_")


ORACLES["top_importances"] = "select 'kmer_' || p_partkey as feature, p_retailprice as importance from part where p_partkey % 2 = 0 order by p_retailprice desc, feature limit 15"


@query
def page_total(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'F'")
    return relational.page_total(o, 20, 50)


ORACLES["page_total"] = "select count(*) as total, 20 as skip, 50 as lim, least(greatest(count(*) - 20, 0), 50) as returned from orders where o_orderstatus = 'F'"


@query
def job_kinds(spark, d):
    return relational.job_kinds(load(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


ORACLES["job_kinds"] = """select o_custkey, 'o_orderstatus' as field, o_orderstatus as value, count(*) as n from orders group by all union all
select o_custkey, 'o_orderpriority', o_orderpriority, count(*) from orders group by all"""


# Preparation.
@query
def drop_missing(spark, d):
    return prep.drop_missing(gaps(spark, d), ["c_acctbal"]).agg(F.count("*").alias("rows"), F.count("c_mktsegment").alias("known"), F.lit(prep.drop_missing(gaps(spark, d)).count()).alias("full"))


ORACLES["drop_missing"] = f"with {GAPS} select count(*) as rows, count(c_mktsegment) as known, (select count(*) from g where c_acctbal is not null and c_mktsegment is not null) as full from g where c_acctbal is not null"


@query
def impute_constant(spark, d):
    return prep.impute_constant(gaps(spark, d), ["c_acctbal", "c_mktsegment"], 0.0, "missing").select("c_custkey", "c_acctbal", "c_mktsegment")


ORACLES["impute_constant"] = f"with {GAPS} select c_custkey, coalesce(c_acctbal, 0) as c_acctbal, coalesce(c_mktsegment, 'missing') as c_mktsegment from g"


@query
def auto_clean(spark, d):
    return prep.auto_clean(gaps(spark, d), "c_mktsegment", ["c_nationkey", "c_acctbal"]).select("c_custkey", "c_nationkey", F.round("c_acctbal", 4).alias("c_acctbal"), "c_mktsegment")


ORACLES["auto_clean"] = f"""with {GAPS}, t as (select * from g where c_mktsegment is not null and (c_nationkey is not null)::int + (c_acctbal is not null)::int >= 1)
select c_custkey, c_nationkey, round(coalesce(c_acctbal, (select quantile_cont(c_acctbal, 0.5) from t)), 4) as c_acctbal, dense_rank() over (order by c_mktsegment) - 1 as c_mktsegment from t"""


@query
def polynomial_degree(spark, d):
    p = prep.polynomial_degree(load(spark, d, "part").select("p_partkey", *PART), PART, 3)
    return p.select("p_partkey", *[F.round(c, 1).alias(c) for c in p.columns if c.startswith("poly_")])


ORACLES["polynomial_degree"] = "select p_partkey, " + ", ".join(
    f"round({' * '.join(f'{c}::double' for c in cs)}, 1) as poly_{'_'.join(cs)}"
    for cs in (("p_size",), ("p_retailprice",), ("p_size",) * 2, ("p_size", "p_retailprice"), ("p_retailprice",) * 2, ("p_size",) * 3, ("p_size", "p_size", "p_retailprice"), ("p_size", "p_retailprice", "p_retailprice"), ("p_retailprice",) * 3)
) + " from part"


@query
def mutual_information(spark, d):
    """Of ten equal-width bins of each column and the return flag, in nats."""
    return prep.mutual_information(load(spark, d, "lineitem"), NUMBERS, "l_returnflag", 10).select("feature", r6(F.col("score"), "score"))


def _mi(c: str) -> str:
    return f"""select '{c}' as feature, round(sum(n / t::double * ln(n * t::double / (a * b))), 6) as score from (select n, sum(n) over () as t, sum(n) over (partition by x) as a, sum(n) over (partition by l_returnflag) as b from
(select least(floor(({c} - lo) / ((hi - lo) / 10)), 9) as x, l_returnflag, count(*) as n from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem) group by all))"""


ORACLES["mutual_information"] = " union all ".join(map(_mi, NUMBERS))


#: Components of an embedding, each a feature of its own.
COMPONENTS = [f"e{i}" for i in range(64)]


def components(spark, d) -> DataFrame:
    e = load(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)])


_LONG = "v as (select vec_id as id, label, i, embedding[i + 1]::double as x from embeddings, range(64) as t(i))"


@query
def select_best(spark, d):
    """The columns that stay when the three best of all embedding components are kept."""
    kept = prep.select_best(components(spark, d), COMPONENTS, "label", 3)
    return spark.createDataFrame([(c,) for c in kept.columns], "column string")


ORACLES["select_best"] = f"""with {_LONG}, per as (select i, label, count(*) as n, avg(x) as m, sum(power(x, 2)) - count(*) * power(avg(x), 2) as ss from v group by all), every as (select i, avg(x) as g from v group by i),
f as (select i, (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) as f from per join every using (i) group by i)
select unnest(['vec_id', 'label']) as "column" union all (select 'e' || i from f order by f desc limit 3)"""


@query
def neighbour_information(spark, d):
    """What each embedding component tells of the label, by the three nearest neighbours of its class."""
    return information.mutual_information(components(spark, d), "vec_id", COMPONENTS, "label").select("feature", r6(F.col("information"), "information"))


def _digamma(n: str) -> str:
    x = f"({n} + 6.0::double)"
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * power({x}, 2)) + 1 / (120 * power({x}, 4)) - 1 / (252 * power({x}, 6)) - " + " - ".join(f"1 / ({n} + {k}.0::double)" for k in range(6)) + ")"


ORACLES["neighbour_information"] = f"""with {_LONG}, far as (select a.i, a.id, a.x, list_sort(list(abs(a.x - b.x)))[least(3, count(*))] as d, least(3, count(*)) as k, count(*) + 1 as size
from v as a join v as b on a.i = b.i and a.label = b.label and a.id <> b.id group by all),
m as (select f.i, f.id, f.k, f.size, count(*) as m from far as f join far as o on f.i = o.i where abs(o.x - f.x) < f.d or o.x = f.x group by all)
select 'e' || i as feature, round(greatest({_digamma("count(*)")} + avg({_digamma("k")}) - avg({_digamma("size")}) - avg({_digamma("m")}), 0), 6) as information from m group by i"""


@query
def three_way_split(spark, d):
    return prep.three_way_split(load(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label").groupBy("label", "part").agg(F.count("*").alias("n"))


ORACLES["three_way_split"] = """with r as (select label, row_number() over (partition by label order by md5(vec_id::varchar), vec_id) as k, count(*) over (partition by label) as n from embeddings),
p as (select label, case when k <= ceil(n * 0.2::double) then 'test' when k <= ceil(n * 0.2::double) + ceil((n - ceil(n * 0.2::double)) * 0.125::double) then 'validation' else 'train' end as part from r) select label, part, count(*) as n from p group by all"""


@query
def pipeline_steps(spark, d):
    steps = [("handle_missing_values", {"columns": ["c_acctbal"], "how": "mean"}), ("outlier_removal", {"columns": ["c_acctbal"]}), ("feature_scaling", {"columns": ["c_acctbal"], "how": "standard"})]
    return prep.run_steps(gaps(spark, d), steps).agg(F.count("*").alias("rows"), F.round(F.sum(F.abs("c_acctbal")), 3).alias("total"))


ORACLES["pipeline_steps"] = f"""with {GAPS}, a as (select coalesce(c_acctbal, (select avg(c_acctbal) from g)) as x from g), q as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from a),
b as (select x from a, q where x between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) select count(*) as rows, round(sum(abs((x - (select avg(x) from b)) / (select stddev_pop(x) from b))), 3) as total from b"""


# Sources and sinks, over files that the query writes to the shared folder.
def _fasta(spark, d) -> str:
    s = seqs(spark, d).where("seq_idx % 8 <> 2")
    record = F.concat(F.lit(">seq"), F.col("seq_idx"), F.lit(" sample_"), F.when(F.col("seq_idx") % 2 == 0, "affected").otherwise("normal"), F.lit("\n# a comment\n"), F.substring("sequence", 1, 100), F.lit("\n"), F.substring("sequence", 101, 156))
    s.select(record.alias("value")).write.text(path := new_path(spark, "fasta"))
    return path


@query
def fasta_scan(spark, d):
    return readers.fasta(spark, _fasta(spark, d)).select("id", "description", "sequence", "length", "label")


ORACLES["fasta_scan"] = f"""with {SEQS} select 'seq' || seq_idx as id, 'seq' || seq_idx || ' sample_' || case when seq_idx % 2 = 0 then 'affected' else 'normal' end as description, s as sequence, 256 as length,
case when seq_idx % 2 = 0 then 'affected' else 'normal' end as label from seqs where seq_idx % 8 <> 2"""


@query
def fasta_clean(spark, d):
    path = new_path(spark, "fasta")
    mixed(spark, d).where("seq_idx % 8 in (1, 3, 4)").select(F.concat(F.lit(">x_"), F.col("seq_idx"), F.lit("\n"), F.col("sequence")).alias("value")).write.text(path)
    return readers.clean_fasta(readers.fasta(spark, path)).select("id", "sequence", "length")


ORACLES["fasta_clean"] = f"""with {SEQS}, m as (select seq_idx, case seq_idx % 8 when 3 then translate(s, 'AC', '') when 4 then translate(s, 'T', '') else s end as s from seqs where seq_idx % 8 in (1, 3, 4))
select 'x_' || seq_idx as id, s as sequence, len(s) as length from m where len(s) > 0"""


@query
def client_fasta(spark, d):
    path = new_path(spark, "fasta")
    mixed(spark, d).where("seq_idx % 8 < 7").select(F.concat(F.lit(">c"), F.col("seq_idx"), F.lit(" x\n"), F.col("sequence")).alias("value")).write.text(path)
    return readers.client_fasta(spark, path)


ORACLES["client_fasta"] = f"""with {SEQS}, m as (select seq_idx, upper(regexp_replace(case seq_idx % 8 when 2 then s[1:seq_idx % 90] when 3 then translate(s, 'AC', 'NR') when 4 then translate(s, 'T', 'U') when 5 then translate(s, 'G', '')
when 6 then repeat(s, 8)[1:2048 - seq_idx % 257] else s end, '[^ATCGURYNWSMKBDHV]', '', 'g')) as s from seqs where seq_idx % 8 < 7)
select 'c' || seq_idx as id, s as sequence, len(s) as length, case when regexp_full_match(s, '[ATCG]*') then 'DNA' when regexp_full_match(s, '[AUCG]*') then 'RNA' else 'PROTEIN' end as type from m where len(s) > 0"""


@query
def fastq_scan(spark, d):
    path = new_path(spark, "fastq")
    s = seqs(spark, d)
    quality = F.repeat(F.chr(F.lit(33) + F.col("seq_idx") % 41), 256)
    s.select(F.concat(F.lit("@r"), F.col("seq_idx"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), quality).alias("value")).write.text(path)
    return readers.fastq(spark, path).select("id", "length", r6(F.col("mean_quality"), "mean_quality"))


ORACLES["fastq_scan"] = "select 'r' || doc_id as id, 256 as length, (doc_id % 41)::double as mean_quality from documents"


@query
def fastq_quality(spark, d):
    return fastq_scan(spark, d).agg(F.min("mean_quality").alias("min"), r6(F.avg("mean_quality"), "avg"), F.max("mean_quality").alias("max"))


ORACLES["fastq_quality"] = "select min(doc_id % 41)::double as min, round(avg(doc_id % 41), 6) as avg, max(doc_id % 41)::double as max from documents"


@query
def csv_scan(spark, d):
    path = new_path(spark, "part")
    load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice").write.csv(path, sep="\t", header=True)
    return readers.delimited(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_retailprice")


ORACLES["csv_scan"] = "select p_partkey, p_brand, p_retailprice from part"


@query
def csv_sample(spark, d):
    """A bounded sample of a file, which is the reader's feature; only its size is fixed."""
    path = new_path(spark, "part")
    load(spark, d, "part").select("p_partkey", "p_brand").write.csv(path, header=True)
    return readers.sample(spark, path, 150).agg(F.count("*").alias("rows"), F.count("p_brand").alias("known"))


ORACLES["csv_sample"] = "select least(count(*), 150) as rows, least(count(*), 150) as known from part"


@query
def sequence_csv(spark, d):
    path = new_path(spark, "sequences")
    mixed(spark, d).where("seq_idx % 8 < 5").select("seq_idx", F.col("sequence").alias("dna_sequence")).write.csv(path, header=True)
    return readers.sequence_lengths(readers.delimited(spark, path)).select("column", "rows", "min", "max", r6(F.col("avg"), "avg"))


ORACLES["sequence_csv"] = f"""with {SEQS}, m as (select case seq_idx % 8 when 2 then seq_idx % 90 else 256 end as n from seqs where seq_idx % 8 < 5)
select 'dna_sequence' as "column", count(*) as rows, min(n)::int as min, max(n)::int as max, round(avg(n), 6) as avg from m where n > 0"""


@query
def text_input(spark, d):
    return readers.text_input(load(spark, d, "documents").select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("sequence")).alias("letters"))


ORACLES["text_input"] = """with l as (select doc_id, unnest(string_split(text, chr(10))) as x from documents where text is not null)
select doc_id, count(*) as lines, sum(len(x))::bigint as letters from l where trim(x, ' ') <> '' group by doc_id"""


@query
def json_payload(spark, d):
    path = new_path(spark, "payload")
    seqs(spark, d).groupBy((F.col("seq_idx") % 7).alias("k")).agg(F.sort_array(F.collect_list("sequence")).alias("sequences")).select(F.to_json(F.struct("k", "sequences")).alias("value")).write.text(path)
    return readers.json_payload(spark, path).select(F.md5("sequence").alias("digest"), F.length("sequence").alias("length"))


ORACLES["json_payload"] = f"with {SEQS} select md5(s) as digest, len(s) as length from seqs"


@query
def ingest(spark, d):
    """A FASTA file checked, read, validated and stored with its row of metadata."""
    store = new_path(spark, "store")
    return readers.ingest(spark, _fasta(spark, d), store, "dna", name="upload.fasta", size=1000).select("status", "rows", "total_length", "type_matches")


ORACLES["ingest"] = f"with {SEQS} select 'valid' as status, count(*) as rows, sum(len(s))::bigint as total_length, true as type_matches from seqs where seq_idx % 8 <> 2"


@query
def fasta_features(spark, d):
    words = ["AAA", "ACG", "TTT"]
    f = sinks.fasta_features(readers.fasta(spark, _fasta(spark, d)), 3, words)
    return f.select("id", "label", "length", *[r6(F.col(c), c) for c in ("gc_content", "a_content", "n_content", *[f"kmer_{w}" for w in words])])


ORACLES["fasta_features"] = f"""with {SEQS}, k as (select seq_idx, unnest(list_transform(range(1, 255), lambda i: s[i:i + 2])) as w from seqs where seq_idx % 8 <> 2), c as (select seq_idx, w, count(*) / 254.0::double as f from k group by all)
select 'seq' || seq_idx as id, case when seq_idx % 2 = 0 then 'affected' else 'normal' end as label, 256 as length, round((len(s) - len(translate(s, 'GC', ''))) * 100.0::double / 256, 6) as gc_content,
round((len(s) - len(replace(s, 'A', ''))) * 100.0::double / 256, 6) as a_content, 0.0::double as n_content, {', '.join(f"(select round(f, 6) from c where c.seq_idx = seqs.seq_idx and w = '{w}') as kmer_{w}" for w in ('AAA', 'ACG', 'TTT'))} from seqs where seq_idx % 8 <> 2"""


@query
def dense_kmer_table(spark, d):
    t = sinks.dense_kmer_table(seqs(spark, d), 2)
    return t.select("id", "length", *[r6(F.col(c), c) for c in ("kmer_AA", "kmer_CG", "kmer_TT")])


ORACLES["dense_kmer_table"] = f"""with {SEQS}, k as (select seq_idx, list_transform(range(1, 256), lambda i: s[i:i + 1]) as w from seqs)
select seq_idx as id, 256 as length, {', '.join(f"round(len(list_filter(w, lambda x: x = '{w}')) / 255.0::double, 6) as kmer_{w}" for w in ('AA', 'CG', 'TT'))} from k"""


@query
def saved_table(spark, d):
    """A prepared table written to a folder named after its source and read again."""
    path = sinks.save_prepared(prep.scale(load(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], "minmax"), new_path(spark, "prepared"), "part.csv")
    return spark.read.csv(path, header=True, inferSchema=True).select(F.col("p_partkey").cast("long").alias("p_partkey"), r6(F.col("p_size"), "p_size"))


ORACLES["saved_table"] = "select p_partkey, round((p_size - (select min(p_size) from part))::double / (select max(p_size) - min(p_size) from part), 6) as p_size from part"


@query
def json_export(spark, d):
    return sinks.as_json(load(spark, d, "nation").select("n_nationkey", "n_name")).select("value")


ORACLES["json_export"] = "select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as value from nation"


@query
def file_hashes(spark, d):
    path = new_path(spark, "hashed")
    load(spark, d, "region").select(F.col("r_name").alias("value")).orderBy("value").coalesce(1).write.text(path)
    return validation.file_hashes(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)).select("sha256", "md5")


ORACLES["file_hashes"] = "with t as (select string_agg(r_name || chr(10), '' order by r_name) as x from region) select sha256(x) as sha256, md5(x) as md5 from t"
