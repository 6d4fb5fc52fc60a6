"""Queries and SQL of the feature, validation and discovery operators, over sequences of mixed kinds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from helixframe import constants as C
from helixframe import sql
from helixframe.catalog.base import load, mixed, query, r6, seqs
from helixframe.catalog.oracles import _PROTEINS, _SEQS_BASE, _share, _occ, _translated  # noqa: F401
from helixframe.catalog.oracles import ORACLES as BASE
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.operators import discovery, features, scans, validation

ORACLES: dict[str, str] = {}
S_ = _SEQS_BASE
MIXED = f"""{S_}, mixed as (select seq_idx, case seq_idx % 8 when 1 then lower(s) when 2 then s[1:seq_idx % 90] when 3 then translate(s, 'AC', 'NR') when 4 then translate(s, 'T', 'U')
when 5 then translate(s, 'G', '-') || repeat('-', (seq_idx % 400)::int) when 6 then repeat(s, 8)[1:2048 - seq_idx % 257] when 7 then coalesce(regexp_replace(text, '[^ -~]', '', 'g'), '') else s end as s
from seqs join documents on doc_id = seq_idx)"""


def div(a: str, b: str) -> str:
    return f"(case when ({b}) = 0 then 0 else ({a})::double / ({b}) end)"


def n_of(s: str, letters: str) -> str:
    return f"(len({s}) - len(translate({s}, '{letters}', '')))"


# Codons of frames: seq_idx, k (frame offset), i (number), c.
CODONS = """cod as (select seq_idx, k, i, u[k + 3 * i + 1:k + 3 * i + 3] as c from (select seq_idx, u, k, unnest(range(0, (len(u) - k) // 3)) as i
from (select seq_idx, u, unnest([0, 1, 2]) as k from up)))"""
ORFS = """seg as (select *, count(*) filter (c in ('TAA', 'TAG', 'TGA')) over (partition by seq_idx, k order by i rows between unbounded preceding and 1 preceding) as g from cod),
o1 as (select seq_idx, k, g, min(i) filter (c = 'ATG') as a, min(i) filter (c in ('TAA', 'TAG', 'TGA')) as z from seg group by seq_idx, k, g),
o2 as (select seq_idx, max((z - a) * 3 + 3) as longest, count(*) as orfs from o1 where a is not null and z is not null group by seq_idx)"""


@query
def client_types(spark, d):
    return mixed(spark, d).select("seq_idx", S.client_type(F.col("sequence")).alias("type"))


ORACLES["client_types"] = f"""with {MIXED} select seq_idx, case when regexp_full_match(upper(s), '[ATCG]*') then 'DNA' when regexp_full_match(upper(s), '[AUCG]*') then 'RNA' else 'PROTEIN' end as type from mixed"""


@query
def inframe_orfs(spark, d):
    o = S.inframe_orfs(F.upper("sequence"))
    return mixed(spark, d).select("seq_idx", o["longest"].cast("long").alias("longest"), o["orfs"].cast("long").alias("orfs"), r6(S.codon_bias(F.upper("sequence")), "codon_bias"))


ORACLES["inframe_orfs"] = f"""with {MIXED}, up as (select seq_idx, upper(s) as u from mixed), {CODONS}, {ORFS},
b as (select seq_idx, max(n) as most, sum(n) as every from (select seq_idx, c, count(*) as n from cod where k = 0 and regexp_full_match(c, '[ACGT]{{3}}') group by all) group by seq_idx)
select seq_idx, coalesce(longest, 0)::bigint as longest, coalesce(orfs, 0)::bigint as orfs, round(case when len(u) % 3 = 0 then least(coalesce(most * 2.0::double / every, 0), 1) else 0 end, 6) as codon_bias
from up left join o2 using (seq_idx) left join b using (seq_idx)"""


@query
def feature_vector(spark, d):
    """Every feature but the k-mers, long form, of sequences of all kinds."""
    named = features.numeric_features(F.col("sequence"))
    # Worked out as columns first: what features share is then worked out once, which an explode does not do.
    wide = mixed(spark, d).select("seq_idx", *[v.cast("double").alias(k) for k, v in named.items()])
    cols = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in named])).alias("x")
    return wide.select("seq_idx", cols).select("seq_idx", "x.feature", F.round(F.col("x.value"), 6).alias("value"))


_REP = "least(len(list_filter(range(1, n - 2), lambda i: u[i:i + 1] = u[i + 2:i + 3])) * 2 / n::double, 1)"
_PER = "list_max([0] || list_transform(list_filter([1, 2, 3], lambda x: x < n // 2), lambda d: len(list_filter(range(1, n - d + 1), lambda i: u[i:i] = u[i + d:i + d]))::double / (n - d)))"
_NAMED = (
    [(f"{x}_freq", div(n_of("u", x), "n")) for x in "ATCG"]
    + [(f"{p}_freq", f"(case when n = 0 then 0 else {_occ('u', p)}::double / greatest(n - 1, 1) end)") for p in C.FEATURE_PAIRS]
    + [
        ("gc_content", div(n_of("u", "GC"), "n")),
        ("purine_pyrimidine_ratio", f"(case when n = 0 then 0 else least({n_of('u', 'AG')}::double / greatest({n_of('u', 'CT')}, 1), 10) end)"),
        ("melting_temp", f"({div(f'4 * {n_of("u", "GC")} + 2 * (n - {n_of("u", "GC")})', 'n')} / 100)"),
        ("entropy", "coalesce(h, 0) / 2"),
        ("repeat_content", f"(case when n < 6 then 0 else {_REP} end)"),
        ("cpg_score", f"(case when n < 20 or {n_of('u', 'C')} = 0 or {n_of('u', 'G')} = 0 then 0 else least({_occ('u', 'CG')} / greatest({n_of('u', 'C')} * {n_of('u', 'G')}::double / n, 1), 2) / 2 end)"),
        ("log_length", "log10(greatest(n, 1)) / 6"),
        ("max_orf_ratio", "coalesce(longest, 0)::double / greatest(n, 1)"),
        ("orf_count", "least(coalesce(orfs, 0) / 10.0::double, 1)"),
        ("codon_bias", "(case when n % 3 = 0 then least(coalesce(most * 2.0::double / every, 0), 1) else 0 end)"),
        ("periodicity", f"(case when n < 6 then 0 else {_PER} end)"),
    ]
)
ORACLES["feature_vector"] = f"""with {MIXED}, up as (select seq_idx, upper(s) as u, len(s) as n from mixed), {CODONS}, {ORFS},
b as (select seq_idx, max(n) as most, sum(n) as every from (select seq_idx, c, count(*) as n from cod where k = 0 and regexp_full_match(c, '[ACGT]{{3}}') group by all) group by seq_idx),
ch as (select seq_idx, x, count(*)::double / any_value(n) as p from (select seq_idx, n, unnest(string_split(u, '')) as x from up where n > 0) group by seq_idx, x),
e as (select seq_idx, -sum(p * log2(p)) as h from ch group by seq_idx),
f as (select * from up left join o2 using (seq_idx) left join b using (seq_idx) left join e using (seq_idx)) """ + " union all ".join(
    f"select seq_idx, '{k}' as feature, round(({v})::double, 6) as value from f" for k, v in _NAMED
)


@query
def sql_functions(spark, d):
    """Features of sequences of all kinds in SQL alone, by the registered functions."""
    sql.register(spark)
    mixed(spark, d).createOrReplaceTempView("mixed_sequences")
    return spark.sql("""with u as (select seq_idx, upper(sequence) as s from mixed_sequences)
        select seq_idx, round(gc_content(s), 6) as gc_content, round(sequence_entropy(s), 6) as entropy, round(melting_temperature(s), 6) as melting_temp, round(repeat_score(s), 6) as repeat_content,
        round(cpg_score(s), 6) as cpg_score, round(periodicity(s), 6) as periodicity, round(codon_bias(s), 6) as codon_bias, cast(orf_longest(s) as bigint) as longest, cast(orf_count(s) as bigint) as orfs from u""")


_FEATURE = dict(_NAMED)
ORACLES["sql_functions"] = ORACLES["feature_vector"].split(" union all ")[0].rsplit("select seq_idx, 'A_freq'", 1)[0] + "select seq_idx, round(coalesce(h, 0), 6) as entropy, coalesce(longest, 0)::bigint as longest, coalesce(orfs, 0)::bigint as orfs, " + ", ".join(
    f"round(({_FEATURE[k]})::double, 6) as {k}" for k in ("gc_content", "melting_temp", "repeat_content", "cpg_score", "periodicity", "codon_bias")
) + " from f"


@query
def vocabulary_transform(spark, d):
    """Shares of the 20 most frequent k-mers of 3 and 4 letters, summed over sequences of all kinds."""
    s = mixed(spark, d)
    words = features.vocabulary(s, (3, 4), 20)
    table = features.vocabulary_frequencies(s, words, 20)
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"kmer_{k}").alias("v")) for k in words])).alias("x")
    long = table.select("seq_idx", one).select("seq_idx", "x.k", F.posexplode("x.v").alias("place", "value"))
    return long.groupBy("k", "place").agg(F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("value") > 0).alias("sequences"))


def _kmers(k: int) -> str:
    return f"select seq_idx, {k} as k, w from (select seq_idx, unnest(list_transform(range(1, len(s) - {k} + 2), lambda i: upper(s[i:i + {k - 1}]))) as w from mixed) where regexp_full_match(w, '[ACGT]+')"


ORACLES["vocabulary_transform"] = f"""with {MIXED}, km as ({_kmers(3)} union all {_kmers(4)}),
v as (select k, w, row_number() over (partition by k order by count(*) desc, w) - 1 as place from km group by k, w), top as (select * from v where place < 20),
t as (select seq_idx, k, count(*) as t from km group by all), c as (select seq_idx, k, w, count(*) as n from km group by all)
select top.k::int as k, place::int as place, round(coalesce(sum(n::double / t), 0), 6) as total, count(n) as sequences from top left join (c join t using (seq_idx, k)) as x on x.k = top.k and x.w = top.w group by all"""


@query
def kmer_dense(spark, d):
    """Each word's summed share in a dense encoding over the alphabet seen."""
    s = seqs(spark, d)
    letters = features.alphabet(s)
    words = F.array(*[F.lit("".join(w)) for w in product(letters, repeat=3)])
    table = features.dense_kmers(s, 3, letters).select(F.posexplode("frequencies").alias("place", "value"))
    return table.groupBy(words[F.col("place")].alias("word")).agg(F.round(F.sum("value"), 6).alias("total"))


ORACLES["kmer_dense"] = f"""with {S_}, a as (select distinct unnest(string_split(s, '')) as x from seqs), v as (select a.x || b.x || c.x as word from a, a as b, a as c),
k as (select seq_idx, len(s) - 2 as n, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i:i + 2])) as word from seqs)
select word, round(coalesce(sum(1.0::double / greatest(n, 1)), 0), 6) as total from v left join k using (word) group by word"""


@query
def evolution_features(spark, d):
    e = features.evolution_features(mixed(spark, d))
    return e.select("seq_idx", *[r6(F.col(c), c) for c in ("bias_score", "transition_ratio", "transversion_ratio", "gc", "conservation")], F.col("codons").cast("long").alias("codons"), F.col("cpg_sites").cast("long").alias("cpg_sites"))


_AMB = "(len(u) - len(translate(u, 'ACGTUSW', '')))"
ORACLES["evolution_features"] = f"""with {MIXED}, up as (select seq_idx, s as u, len(s) as n from mixed), {CODONS},
c as (select seq_idx, count(*) as every, count(*) filter (c in {features.PREFERRED}) as good, count(distinct c) as kinds from cod where k = 0 and regexp_full_match(c, '[ACGT]{{3}}') group by seq_idx),
six as (select seq_idx, count(distinct w) as kinds6 from (select seq_idx, unnest(list_transform(range(1, n - 4), lambda i: u[i:i + 5])) as w from up where n > 5) group by seq_idx)
select seq_idx, round(coalesce(good::double / every, 0), 6) as bias_score, coalesce(kinds, 0) as codons,
round(case when n > 1 then ({' + '.join(_occ('u', p) for p in ('AG', 'GA', 'CT', 'TC'))})::double / (n - 1) else 0 end, 6) as transition_ratio,
round(case when n > 1 then ({' + '.join(_occ('u', p) for p in ('AC', 'CA', 'AT', 'TA', 'GC', 'CG', 'GT', 'TG'))})::double / (n - 1) else 0 end, 6) as transversion_ratio, {_occ('u', 'CG')}::bigint as cpg_sites,
round({div("len(upper(u)) - len(translate(upper(u), 'GCS', ''))", "len(u) - len(translate(upper(u), 'ACGTUSW', ''))")}, 6) as gc,
round(case when n <= 5 then 0 else kinds6::double / least(4096, n - 5) end, 6) as conservation from up left join c using (seq_idx) left join six using (seq_idx)"""


@query
def drug_target_features(spark, d):
    """Protein up to the first stop, its scores and its residue shares by place in the alphabet."""
    t = features.drug_target_features(mixed(spark, d))
    return t.select(
        "seq_idx", "protein", *[r6(F.col(c), c) for c in ("hydrophobicity", "net_charge", "secondary", "binding")], *[r6(F.col("shares")[i], f"share_{x.lower()}") for i, x in enumerate(C.AMINO)]
    )


_CODE_ROWS = ", ".join(f"('{a}{b}{c}', '{C.CODE[16 * i + 4 * j + k]}')" for i, a in enumerate(C.BASES) for j, b in enumerate(C.BASES) for k, c in enumerate(C.BASES))
_TO_STOP = f"""code(c, r) as (values {_CODE_ROWS}), res as (select seq_idx, i, r from cod join code using (c) where k = 0),
cutat as (select *, count(*) filter (r = '*') over (partition by seq_idx order by i rows unbounded preceding) as stops from res),
prot as (select seq_idx, string_agg(r, '' order by i) as p from cutat where stops = 0 group by seq_idx)"""
ORACLES["drug_target_features"] = f"""with {MIXED}, up as (select seq_idx, replace(upper(s), 'U', 'T') as u from mixed), {CODONS}, {_TO_STOP}, x as (select seq_idx, coalesce(p, '') as p from up left join prot using (seq_idx))
select seq_idx, p as protein, round({div(' + '.join(f"{_occ('p', k)} * ({round(10 * v)})" for k, v in C.KYTE_DOOLITTLE.items()), '(len(p) * 10)')}, 6) as hydrophobicity, round({_share('p', 'KRH')} - {_share('p', 'DE')}, 6) as net_charge,
round({_share('p', 'AEHKQR')} + {_share('p', 'FILVWY')}, 6) as secondary, round(case when len(p) = 0 then 0 else ({' + '.join(f"contains(p, '{w}')::int" for w in C.BINDING_WORDS)}) / 6.0::double + {_share('p', 'FWYILV')} end, 6) as binding,
{', '.join(f"round({_share('p', x)}, 6) as share_{x.lower()}" for x in C.AMINO)} from x"""


@query
def pathogen_scores(spark, d):
    """Scores of literals, over sequences to some of which such literals are added."""
    words = F.array(*[F.lit(w) for w in (*C.VIRULENCE_WORDS, *C.RESISTANCE_WORDS, *C.PHYLOGENETIC_WORDS, *C.HOST_WORDS, "")])
    s = mixed(spark, d).withColumn("sequence", F.concat("sequence", words[(F.col("seq_idx") % 15).cast("int")], words[(F.col("seq_idx") % 7 + 8).cast("int")]))
    return features.pathogen_scores(s).select("seq_idx", *[r6(F.col(c), c) for c in ("virulence", "resistance", "phylogenetic", "host")])


_WORDS = "['" + "', '".join((*C.VIRULENCE_WORDS, *C.RESISTANCE_WORDS, *C.PHYLOGENETIC_WORDS, *C.HOST_WORDS, "")) + "']"
ORACLES["pathogen_scores"] = f"""with {MIXED}, x as (select seq_idx, s || ({_WORDS})[seq_idx % 15 + 1] || ({_WORDS})[seq_idx % 7 + 9] as s from mixed)
select seq_idx, round(({' + '.join(f"contains(s, '{w}')::int" for w in C.VIRULENCE_WORDS)}) / 4.0::double, 6) as virulence, round(({' + '.join(f"contains(s, '{w}')::int" for w in C.RESISTANCE_WORDS)}) / 4.0::double, 6) as resistance,
round(least(({' + '.join(_occ('s', w) for w in C.PHYLOGENETIC_WORDS)}) / 10.0::double, 1), 6) as phylogenetic, round(least(({' + '.join(_occ('s', w) for w in C.HOST_WORDS)}) / 5.0::double, 1), 6) as host from x"""


@query
def gene_functions(spark, d):
    """Predicted functions of the proteins of six frames, some with a word of a function added."""
    words = F.array(*[F.lit(w) for w in ("", "KINASE", "BINDING", "CCCCCCCCCCCCCCCC", "RECEPTOR", "CATALYTIC")])
    p = scans.six_frame_proteins(seqs(spark, d)).withColumn("protein", F.concat("protein", words[(F.col("seq_idx") % 6).cast("int")]))
    return p.select("seq_idx", "frame", P.gene_function(F.col("protein")).alias("f")).select("seq_idx", "frame", "f.enzyme_type", "f.domain_family", "f.confidence")


ORACLES["gene_functions"] = f"""with {S_}, {_PROTEINS}, q as (select seq_idx, frame, p || (['', 'KINASE', 'BINDING', 'CCCCCCCCCCCCCCCC', 'RECEPTOR', 'CATALYTIC'])[seq_idx % 6 + 1] as p from proteins),
x as (select *, contains(p, 'CATALYTIC') or contains(p, 'KINASE') as k, contains(p, 'BINDING') or contains(p, 'RECEPTOR') as r, len(p) - len(replace(p, 'C', '')) > len(p) * 0.1 as z from q)
select seq_idx, frame, case when k then 'kinase' when r then 'receptor' else 'unknown' end as enzyme_type, case when not k and not r and z then 'zinc_finger' else 'unknown' end as domain_family,
case when k then 0.8 when r then 0.7 when z then 0.6 else 0.0 end::double as confidence from x"""


@query
def protein_masses(spark, d):
    """Average masses of the proteins of frame 1 without stops and unknown residues taken out."""
    p = scans.six_frame_proteins(seqs(spark, d)).where("frame = 1").withColumn("protein", F.when(F.col("seq_idx") % 3 > 0, F.translate("protein", "*X", "")).otherwise(F.col("protein")))
    return p.select("seq_idx", F.round(P.molecular_weight(F.col("protein")), 3).alias("mass"))


ORACLES["protein_masses"] = f"""with {S_}, {_PROTEINS}, q as (select seq_idx, case when seq_idx % 3 > 0 then translate(p, '*X', '') else p end as p from proteins where frame = 1)
select seq_idx, round(case when regexp_full_match(p, '[{C.AMINO}]+') then ({' + '.join(f"{_occ('p', k)} * {v}::double" for k, v in C.RESIDUE_MASSES.items())}) - {C.WATER_MASS} * (len(p) - 1) else 0 end, 3) as mass from q"""


@query
def isoelectric_points(spark, d):
    p = scans.six_frame_proteins(seqs(spark, d)).where("frame = 1")
    return p.select("seq_idx", F.round(P.isoelectric_point(F.translate("protein", "*X", "")), 3).alias("point"))


@query
def biological_features(spark, d):
    f = features.biological_features(mixed(spark, d))
    return f.select("seq_idx", *[F.col(f"{x}_count").cast("long").alias(f"{x.lower()}_count") for x in "ATGC"], *[r6(F.col(f"{x}_freq"), f"{x.lower()}_freq") for x in ("A", "T", "G", "C", "AT", "GC", "CG", "TT")], r6(F.col("gc_content"), "gc_content"))


ORACLES["biological_features"] = f"""with {MIXED}, u as (select seq_idx, upper(s) as u, len(s) as n from mixed)
select seq_idx, {', '.join(f"{n_of('u', x)}::bigint as {x.lower()}_count, round({div(n_of('u', x), 'n')}, 6) as {x.lower()}_freq" for x in 'ATGC')},
{', '.join(f"round({_occ('u', x)}::double / greatest(1, n - 1), 6) as {x.lower()}_freq" for x in ('AT', 'GC', 'CG', 'TT'))},
round({div(n_of('u', 'GCS'), n_of('u', 'ACGTUSW'))}, 6) as gc_content from u"""


@query
def one_hot_3d(spark, d):
    e = features.one_hot_3d(mixed(spark, d), "sequence", 100).select("seq_idx", F.posexplode("one_hot").alias("place", "hot")).select("place", F.posexplode("hot").alias("letter", "v"))
    return e.groupBy("place", "letter").agg(F.sum("v").alias("n"))


ORACLES["one_hot_3d"] = f"""with {MIXED}, p as (select s, unnest(range(0, 100)) as place from mixed), q as (select s, place, unnest(range(0, 4)) as letter from p)
select place::int as place, letter::int as letter, sum((s[place + 1:place + 1] = 'ACGT'[letter + 1:letter + 1])::int)::bigint as n from q group by all"""


# Validation and quality.
_ISSUE = """u as (select seq_idx, s, upper(s) as u, len(s) as n from mixed),
q as (select *, len(u) - len(translate(u, 'NRYSWKMBDHV', '')) as amb, len(u) - len(replace(u, '-', '')) as gaps, len(translate(u, 'ATCGNRYSWKMBDHV-', '')) as other from u)"""


@query
def fasta_validation(spark, d):
    return validation.type_validation(mixed(spark, d), "dna")


ORACLES["fasta_validation"] = f"""with {MIXED}, a as (select count(*) as sequence_count, count(*) filter (len(s) = 0) as empty, count(*) filter (len(s) < 10) as very_short,
count(*) filter (len(translate(upper(s), 'ATCGURYSWKMBDHVN-', '')) > 0) as invalid_characters from mixed)
select *, case when empty + very_short + invalid_characters > 0 then 'valid_with_warnings' else 'valid' end as status, true as is_valid, 'dna' as detected, true as type_matches from a"""


@query
def nucleotide_quality(spark, d):
    q = validation.nucleotide_quality(mixed(spark, d))
    return q.select("sequences", "with_issues", "ambiguous", "with_ambiguous", r6(F.col("ambiguous_percent"), "ambiguous_percent"), "gaps", "with_gaps", r6(F.col("gaps_percent"), "gaps_percent"), "invalid", "too_short")


ORACLES["nucleotide_quality"] = f"""with {MIXED}, {_ISSUE} select count(*) as sequences, count(*) filter (amb > 0 or gaps > 0 or other > 0 or n < 50) as with_issues, sum(amb)::bigint as ambiguous, count(*) filter (amb > 0) as with_ambiguous,
round(count(*) filter (amb > 0) * 100.0::double / count(*), 6) as ambiguous_percent, sum(gaps)::bigint as gaps, count(*) filter (gaps > 0) as with_gaps, round(count(*) filter (gaps > 0) * 100.0::double / count(*), 6) as gaps_percent,
sum(other)::bigint as invalid, count(*) filter (n < 50) as too_short from q"""


@query
def issue_list(spark, d):
    return validation.issue_list(mixed(spark, d)).select("seq_idx", F.array_join("problems", "; ").alias("problems"))


ORACLES["issue_list"] = f"""with {MIXED}, {_ISSUE}, r as (select seq_idx, concat_ws('; ', case when amb > 0 then 'Contains ' || amb || ' ambiguous bases' end, case when gaps > 0 then 'Contains ' || gaps || ' gaps' end,
case when other > 0 then 'Contains ' || other || ' invalid characters' end, case when n < 50 then 'Very short sequence (' || n || ' bp)' end) as problems from q where seq_idx < 10)
select * from r where problems <> ''"""


@query
def protein_quality(spark, d):
    p = scans.six_frame_proteins(mixed(spark, d)).select(F.col("protein").alias("sequence"))
    return validation.protein_quality(p.unionByName(mixed(spark, d).select("sequence")))


ORACLES["protein_quality"] = f"""with {MIXED}, up as (select seq_idx, replace(upper(s), 'U', 'T') as u from mixed), two as (select u from up union all select reverse(translate(u, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) from up),
six as (select u[k:] as t from (select u, unnest([1, 2, 3]) as k from two)), p as (select {_translated('t')} as p from six union all select upper(s) from mixed)
select count(*) as sequences, sum(len(p) - len(translate(p, 'XBZJ', '')))::bigint as ambiguous, count(*) filter (len(p) > len(translate(p, 'XBZJ', ''))) as with_ambiguous, count(*) filter (contains(p, '-')) as with_gaps from p"""


@query
def sequence_report(spark, d):
    r = validation.sequence_report(mixed(spark, d))
    return r.select("total_length", r6(F.col("avg_length"), "avg_length"), "min_length", "max_length", "empty", "all_n", "mostly_gaps", "with_issues", "recommendations")


ORACLES["sequence_report"] = f"""with {MIXED}, {_ISSUE}, a as (select count(*) as c, sum(n)::bigint as total_length, round(avg(n), 6) as avg_length, min(n) as min_length, max(n) as max_length, count(*) filter (n = 0) as empty,
count(*) filter (n > 0 and translate(u, 'N-', '') = '') as all_n, count(*) filter (n > 0 and gaps * 2 > n) as mostly_gaps, count(*) filter (amb > 0 or gaps > 0 or other > 0 or n < 50) as with_issues from q)
select total_length, avg_length, min_length, max_length, empty, all_n, mostly_gaps, with_issues, concat_ws('; ', case when empty > 0 then 'Remove ' || empty || ' empty sequences' end,
case when all_n > 0 then 'Review ' || all_n || ' sequences with all N bases' end, case when with_issues > c * 0.1 then 'More than 10% of sequences have quality issues - consider data cleaning' end) as recommendations from a"""


@query
def first_composition(spark, d):
    c = validation.first_composition(mixed(spark, d))
    return c.select(*[f"{x}_count" for x in "atgcn"], *[r6(F.col(k), k) for k in (*[f"{x}_share" for x in "atgcn"], "gc_skew", "at_skew")])


ORACLES["first_composition"] = f"""with {MIXED}, u as (select upper(s) as u from mixed where seq_idx < 10), c as (select {', '.join(f"sum({n_of('u', x)})::bigint as {x.lower()}_count" for x in 'ATGCN')}, sum(len(u))::double as t from u)
select * exclude (t), {', '.join(f"round({x}_count / greatest(t, 1), 6) as {x}_share" for x in 'atgcn')}, round((g_count - c_count)::double / greatest(1, g_count + c_count), 6) as gc_skew, round((a_count - t_count)::double / greatest(1, a_count + t_count), 6) as at_skew from c"""


@query
def gc_range(spark, d):
    g = validation.gc_range(mixed(spark, d))
    return g.select(*[r6(F.col(c), c) for c in ("min", "avg", "max")])


ORACLES["gc_range"] = f"""with {MIXED}, u as (select upper(s) as u from mixed where seq_idx < 100), g as (select {div(n_of('u', 'GCS'), n_of('u', 'ACGTUSW'))} as g from u)
select round(min(g), 6) as min, round(avg(g), 6) as avg, round(max(g), 6) as max from g"""


@query
def residue_composition(spark, d):
    p = scans.six_frame_proteins(seqs(spark, d).where("seq_idx < 10")).select(F.col("protein").alias("sequence"))
    return validation.composition(p).select("letter", "n", r6(F.col("percentage"), "percentage"))


ORACLES["residue_composition"] = f"""with {S_}, {_PROTEINS}, c as (select unnest(string_split(p, '')) as letter from proteins where seq_idx < 10), n as (select letter, count(*) as n from c where letter <> '' group by letter)
select letter, n, round(n * 100.0::double / sum(n) over (), 6) as percentage from n"""


@query
def protein_stats(spark, d):
    """Masses of the first 100 proteins of standard residues, which is the feature; population deviation."""
    p = scans.six_frame_proteins(seqs(spark, d).where("seq_idx < 100")).where("frame = 1").select(F.translate("protein", "*X", "").alias("p"))
    m = P.molecular_weight(F.col("p"))
    return p.where(P.is_standard(F.col("p"))).agg(*[F.round(f(m), 3).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


ORACLES["protein_stats"] = f"""with {S_}, {_PROTEINS}, q as (select translate(p, '*X', '') as p from proteins where frame = 1 and seq_idx < 100),
m as (select ({' + '.join(f"{_occ('p', k)} * {v}::double" for k, v in C.RESIDUE_MASSES.items())}) - {C.WATER_MASS} * (len(p) - 1) as m from q where len(p) > 0)
select round(avg(m), 3) as mean, round(stddev_pop(m), 3) as std, round(min(m), 3) as min, round(max(m), 3) as max from m"""


# Discovery.
@query
def gene_totals(spark, d):
    return discovery.gene_totals(seqs(spark, d)).select("min_length", "orfs", "kept", "long", r6(F.col("mean_length"), "mean_length"))


def _six_orfs(source: str = "seqs") -> str:
    from helixframe.catalog.oracles import _FRAMES, _orfs

    return f"{_FRAMES}, {_orfs('six', 't', 'seq_idx, frame')}"


_LIM = "lim as (select case when sum(len(s)) < 50000 then greatest(60, (avg(len(s)) * 0.3)::int) else 300 end as min_length from seqs)"
ORACLES["gene_totals"] = f"""with {S_}, {_six_orfs()}, {_LIM} select min_length, count(*) as orfs, count(*) filter (orf_length >= min_length) as kept,
count(*) filter (orf_length >= greatest(2 * min_length, 200)) as long, round(avg(orf_length), 6) as mean_length from orfs, lim group by min_length"""


@query
def pathogen_totals(spark, d):
    return discovery.pathogen_signatures(seqs(spark, d)).groupBy("kind", "name").agg(F.count("*").alias("n"))


ORACLES["pathogen_totals"] = " union all ".join(
    f"select '{kind}' as kind, name, count(*) as n from ({BASE[q]}) group by name"
    for kind, q in (("bacterial", "bacterial_signatures"), ("viral", "viral_signatures"), ("resistance", "resistance_genes"), ("pathogenicity", "pathogenicity_factors"))
)


@query
def resistance_classes(spark, d):
    r = scans.resistance_genes(seqs(spark, d))
    return r.groupBy("name", discovery.antibiotic_class(F.col("name")).alias("antibiotic_class")).agg(F.count("*").alias("n"))


ORACLES["resistance_classes"] = f"""select name, case name when 'BETA_LACTAMASE' then 'beta_lactams' when 'AMINOGLYCOSIDE' then 'aminoglycosides' when 'TETRACYCLINE' then 'tetracyclines' else 'unknown' end as antibiotic_class,
count(*) as n from ({BASE['resistance_genes']}) group by name"""


@query
def motif_totals(spark, d):
    return discovery.motif_totals(seqs(spark, d))


ORACLES["motif_totals"] = f"""select case when starts_with(family, 'splice') then 'splice' else family end as kind, sum(hits)::bigint as hits from ({BASE['motif_counts']}) group by 1
union all select 'cpg_island', count(*) from ({BASE['cpg_islands']})"""


@query
def mutation_totals(spark, d):
    s = seqs(spark, d).withColumn("sequence", F.expr("substr(sequence, 1, 200 + cast(seq_idx % 56 as int))"))
    return discovery.mutation_totals(s, s.where("seq_idx = 17").select(F.col("sequence").alias("reference"))).select("snvs", "indels", "oncogenic", r6(F.col("mutation_rate"), "mutation_rate"))


_CUT = f"{S_.replace('seqs as', 'whole as', 1)}, seqs as (select seq_idx, s[1:200 + seq_idx % 56] as s from whole)"
ORACLES["mutation_totals"] = f"""with {_CUT}, ref as (select s as r from seqs where seq_idx = 17), x as (select s, r, unnest(range(1, least(len(s), len(r)) + 1)) as i from seqs, ref),
a as (select count(*) filter (s[i:i] <> r[i:i]) as snvs from x), b as (select count(*) as indels from seqs, ref where len(s) <> len(r)),
m(p) as (values ('[AG][AG][AG]C[AT][AT]G[CT][CT][CT]'), ('CACGTG'), ('GGTGGC')), c as (select sum(len(regexp_extract_all(s, p)))::bigint as oncogenic from seqs, m), t as (select sum(len(s)) as t from seqs)
select snvs, indels, oncogenic, round(snvs / t::double, 6) as mutation_rate from a, b, c, t"""


@query
def comprehensive(spark, d):
    return discovery.comprehensive(seqs(spark, d)).select("analysis", "metric", r6(F.col("value"), "value"))


_G = ORACLES["gene_totals"]
ORACLES["comprehensive"] = " union all ".join(
    [f"select 'gene_discovery' as analysis, '{m}' as metric, {m}::double as value from ({_G})" for m in ("orfs", "kept", "long", "mean_length")]
    + ["select 'mutation_analysis', unnest(['snvs', 'indels', 'mutation_rate']), 0.0::double", f"select 'mutation_analysis', 'oncogenic', count(*)::double from ({BASE['oncogenic_hits']})"]
    + [f"select 'drug_targets', 'enzyme_sites', count(*)::double from ({BASE['enzyme_sites']})", f"select 'drug_targets', 'druggable', (count(*) filter (druggable))::double from ({BASE['druggable_proteins']})"]
    + [f"select 'pathogen_detection', kind, sum(n)::double from ({ORACLES['pathogen_totals']}) group by kind", f"select 'motif_analysis', kind, hits::double from ({ORACLES['motif_totals']})"]
    + [f"select 'biomarker_generation', 'conserved_motifs', count(*)::double from ({BASE['conserved_motifs']}) where freq > 0.1 having count(*) > 0"]
    + [f"select 'evolutionary_analysis', unnest(['mean_bias', 'mean_gc']), unnest([round(avg(b), 6), round(avg(g), 6)]) from (select len(list_filter(c, lambda x: x in {features.PREFERRED}))::double / len(c) as b, g from (select list_transform(range(0, len(s) // 3), lambda i: s[3 * i + 1:3 * i + 3]) as c, {_share('s', 'GC')} as g from (with {S_} select * from seqs)))"]
)


@query
def analysis_insights(spark, d):
    """Labels of what the comprehensive analysis found."""
    one = discovery.insights(discovery.insight_counts(discovery.comprehensive(seqs(spark, d))))
    return one.select(*[r6(F.col(c), c) if c in ("regulatory_potential", "pathogenic_potential") else c for c in one.columns])


_OF = lambda a, m: f"coalesce(sum(value) filter (analysis = '{a}' and metric = '{m}'), 0)"
_GRADED = lambda high, moderate: f"case when {high} then 'HIGH' when {moderate} then 'MODERATE' else 'LOW' end"
ORACLES["analysis_insights"] = f"""with f as ({ORACLES["comprehensive"]}), c as (select {_OF("pathogen_detection", "pathogenicity")} as v, {_OF("pathogen_detection", "resistance")} as r, {_OF("drug_targets", "druggable")} as dr, {_OF("drug_targets", "enzyme_sites")} as en,
{_OF("motif_analysis", "promoter")} as p, {_OF("motif_analysis", "enhancer")} as h, {_OF("motif_analysis", "tf_site")} as t, {_OF("biomarker_generation", "discriminative_kmers")} as d, {_OF("biomarker_generation", "conserved_motifs")} as m,
{_OF("mutation_analysis", "oncogenic")} as o, {_OF("mutation_analysis", "snvs")} as s from f)
select {_GRADED("v > 5 and r > 3", "v > 2 or r > 1")} as outbreak_potential, {_GRADED("dr > 3 and en > 2", "dr > 1 or en > 0")} as therapeutic_potential, round(least((p * 3 + h * 2 + t) / 10, 10), 6) as regulatory_potential,
{_GRADED("d > 20", "d > 10")} as discriminative_power, {_GRADED("m > 5", "m > 2")} as clinical_applicability, round(case when s = 0 then 0 else least(o * 100 / greatest(s, 1), 100) end, 6) as pathogenic_potential from c"""


@query
def sequence_metadata(spark, d):
    """An upload of sequences of all kinds, with its composition."""
    one = validation.metadata(mixed(spark, d), "dna", "upload.FASTA", 5_000_000)
    return one.select(*[r6(F.col(c), c) if k == "double" else c for c, k in one.dtypes])


ORACLES["sequence_metadata"] = f"""with {MIXED}, l as (select len(s) as n, row_number() over (order by len(s)) as k, count(*) over () as c from mixed),
g as (select round(min(min) * 100, 4) as gc_min, avg * 100 as gc_mean, max * 100 as gc_max from (select min(g) as min, avg(g) as avg, max(g) as max from (select {div(n_of('u', 'GCS'), n_of('u', 'ACGTUSW'))} as g from (select upper(s) as u from mixed where seq_idx < 1000))) group by all),
f as ({ORACLES["first_composition"]})
select 'upload.FASTA' as file_name, 4.77::double as file_size_mb, '.fasta' as file_extension, 'dna' as dataset_type, count(*) as total_sequences, min(n)::int as min_length, max(n)::int as max_length, round(avg(n), 6) as mean_length, max(case when k = c // 2 + 1 then n end)::int as median_length,
any_value(gc_min) as gc_min, round(any_value(gc_mean), 6) as gc_mean, round(any_value(gc_max), 6) as gc_max, {", ".join(f"any_value(f.{x}_count) as {x}_count, any_value(f.{x}_share) as {x}_share" for x in "atgcn")}, any_value(f.gc_skew) as gc_skew, any_value(f.at_skew) as at_skew,
0.95::double as quality_score, 0.98::double as completeness, 0.01::double as contamination from l, g, f"""


@query
def dataset_summary(spark, d):
    one = validation.dataset_summary(validation.metadata(mixed(spark, d), "dna", "upload.fasta", 5_000_000))
    return one.withColumn("avg_sequence_length", r6(F.col("avg_sequence_length"), "avg_sequence_length"))


ORACLES["dataset_summary"] = f"""with {MIXED} select count(*) as total_records, '4.77 MB' as file_size, 'dna' as dataset_type, count(*) as sequence_count, round(avg(len(s)), 6) as avg_sequence_length,
min(len(s))::int as min_sequence_length, max(len(s))::int as max_sequence_length from mixed"""


@query
def protein_statistics(spark, d):
    """Masses and isoelectric points of the first proteins, all six frames."""
    p = scans.six_frame_proteins(seqs(spark, d)).select("seq_idx", F.translate("protein", "*X", "").alias("sequence"))
    return validation.protein_statistics(p)


@query
def batches(spark, d):
    """Greedy batches of the documents' lengths in order of their ids."""
    t = load(spark, d, "documents").select(F.col("doc_id").alias("seq_idx"), F.coalesce("text", F.lit("")).alias("sequence"))
    return discovery.greedy_batches(t, 100, 50_000)


@query
def batch_rollup(spark, d):
    return discovery.batch_rollup(mixed(spark, d).withColumn("sequence", F.upper("sequence")), letters=20_000).select("metric", r6(F.col("value"), "value"))


@query
def insights(spark, d):
    """Labels of each document's counts, drawn from a digest of its id."""
    h = F.md5(F.col("doc_id").cast("string"))
    names = ("virulence", "resistance", "druggable", "enzyme_sites", "promoters", "enhancers", "tf_sites", "discriminative", "frequent_motifs", "oncogenic", "snvs")
    counts = load(spark, d, "documents").select("doc_id", *[(F.conv(F.substring(h, 2 * i + 1, 1), 16, 10).cast("int") * (2 if n == "discriminative" else 1) - (8 if i % 2 else 0)).alias(n) for i, n in enumerate(names)])
    counts = counts.select("doc_id", *[F.greatest(F.col(n), F.lit(0)).alias(n) for n in names])
    one = discovery.insights(counts.withColumn("id", F.col("doc_id")))
    cols = [c for c in one.columns]
    return one.groupBy(*[F.round(c, 6).alias(c) if c in ("regulatory_potential", "pathogenic_potential") else F.col(c) for c in cols]).agg(F.count("*").alias("n"))


def _digit(i: int, times: int) -> str:
    return f"greatest(('0x' || h[{2 * i + 1}:{2 * i + 1}])::int * {times} - {8 if i % 2 else 0}, 0)"


_INS = ", ".join(f"{_digit(i, 2 if n == 'discriminative' else 1)} as {n}" for i, n in enumerate(("virulence", "resistance", "druggable", "enzyme_sites", "promoters", "enhancers", "tf_sites", "discriminative", "frequent_motifs", "oncogenic", "snvs")))
ORACLES["insights"] = f"""with h as (select md5(doc_id::varchar) as h from documents), c as (select {_INS} from h)
select case when virulence > 5 and resistance > 3 then 'HIGH' when virulence > 2 or resistance > 1 then 'MODERATE' else 'LOW' end as outbreak_potential,
case when druggable > 3 and enzyme_sites > 2 then 'HIGH' when druggable > 1 or enzyme_sites > 0 then 'MODERATE' else 'LOW' end as therapeutic_potential,
round(least((promoters * 3 + enhancers * 2 + tf_sites) / 10.0::double, 10), 6) as regulatory_potential, case when discriminative > 20 then 'HIGH' when discriminative > 10 then 'MODERATE' else 'LOW' end as discriminative_power,
case when frequent_motifs > 5 then 'HIGH' when frequent_motifs > 2 then 'MODERATE' else 'LOW' end as clinical_applicability,
round(case when snvs = 0 then 0 else least(oncogenic * 100.0::double / snvs, 100) end, 6) as pathogenic_potential, count(*) as n from c group by all"""
