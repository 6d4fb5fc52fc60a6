"""The same queries in DuckDB SQL, written apart from the Spark code."""

from __future__ import annotations

from helixframe import constants as C

_MD5 = " || ".join(f"md5(doc_id::varchar || '{x}')" for x in "abcdefgh")
SEQS = f"seqs as (select doc_id as seq_idx, translate({_MD5}, '0123456789abcdef', 'ACGTACGTACGTACGT') as s from documents)"
_GC = "(len(s) - len(translate(s, 'GC', '')))::double / len(s)"
ORACLES: dict[str, str] = {}
_SEQS_BASE = SEQS


def _motifs(rows) -> str:
    return ", ".join(f"('{f}', '{n}', '{p}', {m}, {score}::double)" for f, n, p, m, score in rows)


def _hits(rows) -> str:
    """CTE hits(seq_idx, s, family, motif, score, position)."""
    start = "list_sum(list_transform(p[1:j], lambda x: len(x)))::int + (j - 1) * m"
    return f"""m(family, motif, re, m, score) as (values {_motifs(rows)}),
pieces as (select seq_idx, s, family, motif, score, m, regexp_split_to_array(s, re) as p from seqs, m),
hits as (select seq_idx, s, family, motif, score, unnest(list_transform(range(1, len(p)), lambda j: {start})) as position from pieces)"""


_FRAMES = """frames as (select seq_idx, len(s) as n, unnest([1, 2, 3]) as k, 1 as sign, s as t from seqs union all
  select seq_idx, len(s), unnest([1, 2, 3]), -1, reverse(translate(s, 'ACGT', 'TGCA')) from seqs),
six as (select seq_idx, n, sign * k as frame, t[k:] as t from frames)"""
_CODE = "map {" + ", ".join(
    f"'{a}{b}{c}': '{C.CODE[16 * i + 4 * j + k]}'" for i, a in enumerate(C.BASES) for j, b in enumerate(C.BASES) for k, c in enumerate(C.BASES)
) + "}"


def _translated(t: str) -> str:
    return f"array_to_string(list_transform(range(0, len({t}) // 3), lambda i: coalesce({_CODE}[{t}[3 * i + 1:3 * i + 3]], 'X')), '')"


_PROTEINS = f"{_FRAMES}, proteins as (select seq_idx, n, frame, {_translated('t')} as p from six)"


def _orfs(source: str, s: str, keys: str) -> str:
    stop = f"list_min(list_filter(range(1, greatest((len({s}) - st - 2) // 3, 1) + 1), lambda k: {s}[st + 3 * k:st + 3 * k + 2] in ('TAA', 'TAG', 'TGA')))"
    return f"""starts as (select {keys}, {s}, unnest(list_filter(range(1, len({s}) - 1), lambda i: {s}[i:i + 2] = 'ATG')) as st from {source}),
stops as (select *, {stop} as k from starts),
orfs as (select {keys}, st - 1 as start, st + 3 * k + 2 as "end", 3 * k + 3 as orf_length, {s}[st:st + 3 * k + 2] as orf from stops where k is not null)"""


def _firsts(table, s: str, score: float) -> str:
    return " union all ".join(f"select *, '{n}' as name, instr({s}, '{p}') - 1 as position, {score}::double as confidence from src where contains({s}, '{p}')" for n, p in table)


def _loose(table, s: str, score: float) -> str:
    parts = []
    for name, ps in table:
        pick = " ".join(f"when contains({s}, '{p}') then instr({s}, '{p}') - 1" for p in ps)
        parts.append(f"select *, '{name}_PARTIAL' as name, case {pick} end as position, {score}::double as confidence from src")
    return f"select * from ({' union all '.join(parts)}) where position is not null"


def _share(p: str, letters: str) -> str:
    return f"(case when len({p}) = 0 then 0 else (len({p}) - len(translate({p}, '{letters}', '')))::double / len({p}) end)"


def _occ(s: str, part: str) -> str:
    return f"((len({s}) - len(replace({s}, '{part}', ''))) // {len(part)})"


def _kmers(k: int, source: str = "seqs") -> str:
    return f"select *, unnest(list_transform(range(1, len(s) - {k} + 2), lambda i: s[i:i + {k - 1}])) as kmer from {source}"


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _union(parts) -> str:
    return " union all ".join(parts)


def _shape(c: str) -> str:
    return f"""select '{c}' as "column", avg(power(z, 3)) as skew, avg(power(z, 4)) - 3 as kurt from
(select ({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem) as z from lineitem)"""


_DRUG = f"""{SEQS}, {_PROTEINS},
p1 as (select * from proteins where len(p) > case when n < 500 then 20 else 50 end),
p2 as (select *, contains(p, 'HDS') or contains(p, 'DFG') or contains(p, 'CxxC') as strict,
  n < 500 and regexp_matches(p, 'HD|DS|HG|CC|HH|CG|GK|MG|DG') as loose from p1),
p3 as (select *, (least({_share('p', 'AILMFWYV')} * 1.5, 1) * least({_share('p', 'DEKR')} * 2, 1) * least({_share('p', 'STNQ')} * 2, 1)
  + len(list_distinct(string_split(p, ''))) / 20.0::double) / 2 as base from p2),
drug as (select seq_idx, n, frame, p, strict, case when strict or loose then least(base + 0.2, 1) else base end as score,
  case when n < 500 then 0.4 else 0.7 end as bar from p3)"""

ORACLES |= {
    "motif_counts": f"with {SEQS}, {_hits(C.MOTIFS)} select family, motif, count(*) as hits, count(distinct seq_idx) as sequences from hits group by all",
    "motif_positions": f"with {SEQS}, {_hits(C.MOTIFS)} select family, motif, position, count(*) as hits from hits group by all",
    "oncogenic_hits": f"with {SEQS}, {_hits(C.ONCOGENIC)} select seq_idx, motif, position, score from hits",
    "promoter_strength": f"""with {SEQS}, {_hits([m for m in C.MOTIFS if m[0] == 'promoter'])},
r as (select seq_idx, motif, position, s[greatest(0, position - 100) + 1:position + 100] as s from hits),
g as (select *, {_GC} as gc from r)
select seq_idx, motif, position, case when gc between 0.4 and 0.6 then 0.8 when gc between 0.3 and 0.7 then 0.6 else 0.4 end::double as strength from g""",
    "cpg_islands": f"""with {SEQS}, w as (select seq_idx, s as whole, unnest(range(0, len(s) - 200, 50)) as start from seqs),
x as (select seq_idx, start, whole[start + 1:start + 200] as s from w),
y as (select *, {_GC} as gc, {_occ('s', 'CG')} * 100 / 200.0::double as cpg from x)
select seq_idx, start, start + 200 as "end", round(gc, 6) as gc, round(cpg, 6) as cpg, round(least(cpg / 2, 1), 6) as methylation from y where gc > 0.5 and cpg > 0.6""",
    "orf_all": f"""with {SEQS}, {_orfs('seqs', 's', 'seq_idx')}
select seq_idx, start, "end", orf_length, {_translated('orf')} as protein, right(orf, 3) as stop from orfs""",
    "orf_six_frame": f"with {SEQS}, {_FRAMES}, {_orfs('six', 't', 'seq_idx, frame')} select frame, count(*) as orfs, max(orf_length) as longest from orfs group by frame",
    "gene_stats": f"""with {SEQS}, {_FRAMES}, {_orfs('six', 't', 'seq_idx, frame')},
lim as (select case when sum(len(s)) < 50000 then greatest(60, (avg(len(s)) * 0.3)::int) else 60 end as min_length from seqs),
c as (select *, list_transform(range(0, len(orf) // 3), lambda i: orf[3 * i + 1:3 * i + 3]) as cod from orfs, lim where orf_length >= min_length)
select seq_idx, count(*) as genes, max(orf_length) as longest, min(min_length) as min_length,
round(max(least(len(list_filter(cod, lambda x: x in ('ATG', 'TGG', 'TTT', 'AAA', 'GAA')))::double / len(cod) * 2, 1)), 6) as coding from c group by seq_idx""",
    "snv_vs_reference": f"""with {SEQS}, ref as (select s as r from seqs order by seq_idx limit 1),
x as (select s, r, unnest(range(1, least(len(s), len(r)) + 1)) as i from seqs, ref)
select i - 1 as position, r[i:i] as ref, s[i:i] as alt, count(*) as n from x where s[i:i] <> r[i:i] group by all""",
    "mutation_stats": f"""with {SEQS}, ref as (select s as r from seqs order by seq_idx limit 1),
x as (select s, r, unnest(range(1, 257)) as i from seqs, ref), n as (select count(*) as snvs from x where s[i:i] <> r[i:i])
select snvs, round(snvs / (select sum(len(s)) from seqs)::double, 6) as mutation_rate from n""",
    "tail_indels": f"""with {SEQS}, t as (select seq_idx, 200 + seq_idx % 56 as n from seqs), r as (select n as m from t where seq_idx > 10 order by seq_idx limit 1)
select seq_idx, case when n > m then 'insertion' else 'deletion' end as kind, least(n, m) as position, abs(n - m) as size from t, r where n <> m""",
    "bacterial_signatures": f"""with {SEQS}, src as (select * from seqs), strict as ({_firsts(C.BACTERIAL, 's', 0.8)}), loose as ({_loose(C.BACTERIAL_LOOSE, 's', 0.6)})
select seq_idx, name, position, confidence from strict union all
select seq_idx, name, position, confidence from loose where len(s) < 500 and seq_idx not in (select seq_idx from strict)""",
    "viral_signatures": f"with {SEQS}, src as (select * from seqs) select seq_idx, name, position, confidence from ({_firsts(C.VIRAL, 's', 0.7)})",
    "resistance_genes": f"""with {SEQS}, {_PROTEINS}, src as (select * from proteins)
select seq_idx, frame, name, position, confidence from ({_firsts([x[:2] for x in C.RESISTANCE], 'p', 0.8)}) union all
select seq_idx, frame, 'POTENTIAL_BETA_LACTAMASE', least(instr(p, 'S'), instr(p, 'K')) - 1, 0.5 from src
where n < 1000 and contains(p, 'S') and contains(p, 'K') and abs(instr(p, 'S') - instr(p, 'K')) < 10""",
    "pathogenicity_factors": f"with {SEQS}, {_PROTEINS}, src as (select * from proteins) select seq_idx, frame, name, position, confidence from ({_firsts(C.VIRULENCE, 'p', 0.8)})",
    "enzyme_sites": f"""with {_DRUG}, src as (select seq_idx, frame, p, n, strict from drug),
a as ({_firsts(C.ENZYME, 'p', 0.9)}), b as ({_loose(C.ENZYME_LOOSE, 'p', 0.6)})
select seq_idx, frame, name, position, confidence from a union all select seq_idx, frame, name, position, confidence from b where not strict and n < 500""",
    "druggable_proteins": f"with {_DRUG} select seq_idx, frame, round(score, 6) as score, score > bar as druggable from drug",
    "top_targets": f"with {_DRUG} select seq_idx, frame, round(score, 6) as score from drug where score > bar order by drug.score desc, seq_idx, frame desc limit 5",
    "composition": f"""with {SEQS}, c as (select unnest(string_split(s, '')) as letter from seqs), n as (select letter, count(*) as n from c group by letter)
select letter, n, round(n * 100 / (sum(n) over ())::double, 6) as percentage from n""",
    "gc_stats": f"""with {SEQS}, g as (select {_GC} * 100 as gc from seqs where seq_idx < 1000)
select round(avg(gc), 6) as mean, round(stddev_pop(gc), 6) as std, round(min(gc), 6) as min, round(max(gc), 6) as max from g""",
    "length_stats": """with l as (select coalesce(len(text), 0) as n from documents), o as (select n, row_number() over (order by n) as k, count(*) over () as c from l)
select count(*) as rows, sum(n)::bigint as total, round(avg(n), 6) as mean, min(n) as min, max(n) as max, max(case when k = c // 2 + 1 then n end)::bigint as upper_median from o""",
    "sequence_features": f"""with {SEQS}, f as (select seq_idx, s, len(s) as n, {_GC} as gc, {_share('s', 'A')} as a, {_share('s', 'T')} as t, {_share('s', 'C')} as c, {_share('s', 'G')} as g,
list_transform(range(1, 4), lambda d: len(list_filter(range(1, len(s) - d + 1), lambda i: s[i:i] = s[i + d:i + d]))::double / (len(s) - d)) as per,
list_transform(range(0, len(s) // 3), lambda i: s[3 * i + 1:3 * i + 3]) as cod from seqs)
select seq_idx, round(gc, 6) as gc, round(gc, 6) as gc_unambiguous, round(a, 6) as share_a, round(t, 6) as share_t, round(c, 6) as share_c, round(g, 6) as share_g,
round((a + t) / (g + c + 0.001), 6) as at_gc_ratio, round(-list_sum(list_transform(list_filter([a, c, g, t], lambda x: x > 0), lambda x: x * log2(x))), 6) as entropy,
round(least((a + g) / (c + t), 10), 6) as purine_ratio, round((4 * gc + 2 * (1 - gc)) / 100, 6) as melting,
round(least(len(list_filter(range(1, n - 2), lambda i: s[i:i + 1] = s[i + 2:i + 3])) * 2 / n::double, 1), 6) as repeat_score,
round(least({_occ('s', 'CG')} / greatest(c * n * g * n / n, 1), 2) / 2, 6) as cpg_score, round(list_max(per), 6) as periodicity, round(log10(n) / 6, 6) as log_length,
round(least(len(list_filter(cod, lambda x: x in ('ATG', 'TGG', 'TTT', 'AAA', 'GAA')))::double / len(cod) * 2, 1), 6) as coding_potential from f""",
    "dinucleotide_freq": f"""with {SEQS}, p as (select a || b as pair from (select unnest(['A','T','G','C']) as a), (select unnest(['A','T','G','C']) as b))
select seq_idx, pair, round((len(s) - len(replace(s, pair, ''))) / 2 / (len(s) - 1)::double, 6) as freq from seqs, p""",
    "reverse_complements": f"with {SEQS} select seq_idx, reverse(translate(s, 'ACGT', 'TGCA')) as reverse_complement from seqs",
    "six_frame_proteins": f"with {SEQS}, {_PROTEINS} select seq_idx, frame, p as protein from proteins",
    "protein_features": f"""with {SEQS}, {_PROTEINS} select seq_idx, ({' + '.join(f"{_occ('p', k)} * {v}" for k, v in C.RESIDUE_WEIGHTS.items())})::bigint as weight,
round(({' + '.join(f"{_occ('p', k)} * ({round(10 * v)})" for k, v in C.KYTE_DOOLITTLE.items())})::double / (len(p) * 10), 6) as hydrophobicity,
round({_share('p', 'KRH')} - {_share('p', 'DE')}, 6) as net_charge, round({_share('p', 'AEHKQR')} + {_share('p', 'FILVWY')}, 6) as secondary from proteins where frame = 1""",
    "codon_usage": f"""with {SEQS}, c as (select unnest(list_transform(range(0, len(s) // 3), lambda i: s[3 * i + 1:3 * i + 3])) as codon from seqs),
n as (select codon, count(*) as n from c group by codon) select codon, n, round(n / (sum(n) over ())::double, 6) as freq from n""",
    "substitution_patterns": f"""with {SEQS} select seq_idx, round(({' + '.join(_occ('s', p) for p in ('AG', 'GA', 'CT', 'TC'))}) / (len(s) - 1)::double, 6) as transitions,
round(({' + '.join(_occ('s', p) for p in ('AC', 'CA', 'AT', 'TA', 'GC', 'CG', 'GT', 'TG'))}) / (len(s) - 1)::double, 6) as transversions, {_occ('s', 'CG')}::bigint as cpg_sites from seqs""",
    "selection_pressure": f"""with {SEQS} select seq_idx, round({_GC}, 6) as gc,
round(len(list_distinct(list_transform(range(1, len(s) - 4), lambda i: s[i:i + 5]))) / least(4096, len(s) - 5)::double, 6) as complexity from seqs""",
    "sequence_types": f"""with {SEQS}, t as (select doc_id, upper(trim(coalesce(text, ''), ' ')) as x, upper(coalesce(text, '')) as y from documents),
c as (select *, list_distinct(string_split(x, '')) as k from t)
select doc_id, case when len(list_intersect(k, ['A','T','C','G'])) / len(k)::double > 0.9 and not contains(y, 'U') then 'dna'
when len(list_intersect(k, ['A','U','C','G'])) / len(k)::double > 0.9 and contains(y, 'U') then 'rna'
when len(list_intersect(k, string_split('ACDEFGHIKLMNPQRSTVWY', ''))) / len(k)::double > 0.8 then 'protein' else 'unknown' end as of_text, 'dna' as of_bases from c""",
    "header_labels": """select doc_id, (['affected', 'affected', 'normal', 'normal', 'x1'])[doc_id % 5 + 1] as label,
(['affected', 'normal', 'normal', 'normal', 'x1'])[doc_id % 5 + 1] as strict_label from documents""",
    "sequence_quality": """with t as (select translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as s from documents), c as (select len(s) as n, len(s) - len(translate(s, 'NRYSWKMBDHV', '')) as amb,
len(s) - len(replace(s, '-', '')) as gaps, len(translate(s, 'ATCGURYSWKMBDHVN-', '')) as bad from t)
select sum(amb)::bigint as ambiguous, count(*) filter (amb > 0) as with_ambiguous, sum(gaps)::bigint as gaps, sum(bad)::bigint as invalid,
count(*) filter (n < 50) as short, count(*) filter (n = 0) as empty, count(*) filter (n > 0 and gaps * 2 > n) as mostly_gaps from c""",
    "kmer_freq": f"""with {SEQS}, k as ({_kmers(3)}), c as (select seq_idx, kmer, count(*) as count from k group by all)
select seq_idx, kmer, count, round(count / (sum(count) over (partition by seq_idx))::double, 6) as freq from c""",
    "kmer_vocab_topn": f"""with {SEQS}, c as ({_union(f"select {k} as k, kmer, count(*) as count from ({_kmers(k)}) group by kmer" for k in (3, 4, 5, 6))}),
r as (select *, row_number() over (partition by k order by count desc, kmer) as rank from c) select * from r where rank <= 100""",
    "discriminative_kmers": f"""with {SEQS}, l as (select seqs.*, quality::varchar as label from seqs join labels on seq_idx = doc_id),
c as ({_union(f"select {k} as k, label, kmer, count(*)::double as n from ({_kmers(k, 'l')}) group by label, kmer" for k in (3, 4, 5))}),
t as (select *, sum(n) over (partition by k, label) as own, sum(n) over (partition by k) as every, sum(n) over (partition by k, kmer) as word from c),
f as (select label, k, kmer, n / own as freq, (word - n) / (every - own) as rest, word - n as others from t)
select label, k, kmer, round(freq, 6) as freq, round(freq / (rest + 0.001), 6) as fold from f where others > 0 and freq / (rest + 0.001) > 1.05""",
    "conserved_motifs": f"""with {SEQS}, c as ({_union(f"select {k} as k, kmer, count(*) as count from ({_kmers(k)}) group by kmer" for k in (6, 7, 8))}),
r as (select *, row_number() over (partition by k order by count desc, kmer) as rank from c), n as (select sum(len(s)) as t, count(*) as m from seqs)
select k, kmer, count, round(count / (t - m * (k - 1))::double, 9) as freq, round(count * k / (t - m * (k - 1))::double, 9) as score from r, n where rank <= 20""",
    "integer_encode": f"""with {SEQS}, p as (select s, unnest(range(1, 301)) as i from seqs)
select i - 1 as pos, case when i > len(s) then 0 else instr('ACGT', s[i:i]) end as code, count(*) as n from p group by all""",
    "one_hot": f"""with {SEQS}, p as (select s, unnest(range(0, 1024)) as pos from seqs)
select pos, sum((s[pos // 4 + 1:pos // 4 + 1] = 'ACGT'[pos % 4 + 1:pos % 4 + 1])::int)::bigint as n from p group by pos""",
    "pad_truncate": f"with {SEQS} select seq_idx, rpad(s, 300, 'N') as padded, s[1:100] as cut from seqs",
    "column_profile": _union(
        f"""select '{c}' as "column", count({c}) as n, count(*) - count({c}) as missing, count(distinct {c}) as distinct, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std,
round(min({c}), 4) as min, round(max({c}), 4) as max, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75 from lineitem"""
        for c in NUM
    ),
    "distribution_shape": f"""select "column", round(skew, 6) as skew, round(kurt, 6) as kurt, case when skew > 1 then 'Right-skewed' when skew < -1 then 'Left-skewed'
when kurt > 3 then 'Heavy-tailed' when kurt < -3 then 'Light-tailed' else 'Normal' end as shape from ({_union(map(_shape, NUM))})""",
    "iqr_outliers": _union(
        f"""select '{c}' as "column", count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers,
round(count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count({c}), 6)::double as percentage
from {t}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t})"""
        for c, t in (("c_acctbal", "customer"), ("value", "events"))
    ),
    "correlation_pairs": _union(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, abs(corr({a}, {b})) > 0.7 as strong from lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1 :]
    ),
    "feature_relationships": f"""with r as ({_union(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for a in NUM for b in NUM if a != b)})
select a, arg_max(b, r) as strongest_positive, arg_min(b, r) as strongest_negative, round(avg(abs(r)), 6) as mean_strength from r group by a""",
    "quality_numeric": _union(
        f"""select '{c}' as "column", round(m, 6) as mean, round(md, 6)::double as median, round(sd, 6) as std, d as distinct, (select count(*) from customer where abs({c} - m) > 3 * sd) as outliers
from (select avg({c}) as m, quantile_cont({c}, 0.5) as md, stddev_samp({c}) as sd, count(distinct {c}) as d from customer)"""
        for c in ("c_acctbal", "c_nationkey")
    ),
    "quality_categorical": _union(
        f"""select '{c}' as "column", count(*) as distinct, (array_agg(v order by n desc, v))[1] as mode, max(n) as mode_count, (array_agg(v order by n, v))[1] as rarest
from (select {c} as v, count(*) as n from {t} where {c} is not null group by {c})"""
        for c, t in (("c_mktsegment", "customer"), ("o_orderstatus", "orders"), ("o_orderpriority", "orders"))
    ),
    "duplicate_rows": """select sum(n)::bigint as total, sum(n - 1)::bigint as duplicates from
(select count(*) as n from lineitem group by l_returnflag, l_linestatus, l_quantity, l_discount)""",
    "quality_score": """with s as (select count(*) as rows, sum((c_acctbal is null)::int + (c_nationkey is null)::int + (c_mktsegment is null)::int) as miss,
avg(c_acctbal) as ma, stddev_samp(c_acctbal) as sa, avg(c_nationkey) as mn, stddev_samp(c_nationkey) as sn from customer),
d as (select sum(n - 1)::bigint as duplicates from (select count(*) as n from customer group by c_acctbal, c_nationkey, c_mktsegment)),
f as (select (count(*) filter (abs(c_acctbal - ma) > 3 * sa) + count(*) filter (abs(c_nationkey - mn) > 3 * sn))::bigint as far from customer, s)
select round(greatest(100 - least(2 * miss * 100.0 / (rows * 3), 40) - least(3 * duplicates * 100.0 / rows, 30) - least(far * 100.0 / rows, 20), 0), 2)::double as score, rows, duplicates, far from s, d, f""",
    "value_histogram": """with r as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
select least(floor((l_extendedprice - lo) / ((hi - lo) / 30)), 29)::bigint as bin, count(*) as n from lineitem, r group by 1""",
    "impute_mean": "with g as (select event_id, case when event_id % 7 <> 0 then value end as v from events) select event_id, round(coalesce(v, (select avg(v) from g)), 4) as value from g",
    "impute_median": "with g as (select event_id, case when event_id % 7 <> 0 then value end as v from events) select event_id, round(coalesce(v, (select quantile_cont(v, 0.5) from g)), 4) as value from g",
    "impute_mode": """with g as (select case when event_id % 5 <> 0 then event_type end as t from events), m as (select t from g where t is not null group by t order by count(*) desc, t limit 1)
select coalesce(t, (select t from m)) as event_type, count(*) as n from g group by 1""",
    "forward_fill": """select event_id, last_value(case when event_id % 7 <> 0 then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as value from events""",
    "drop_sparse_rows": """with g as (select case when event_id % 14 <> 0 then event_type end as a, case when event_id % 7 <> 0 then value end as b, case when event_id % 3 <> 0 then user_id end as c from events)
select count(*) as rows, count(b) as known from g where (a is not null)::int + (b is not null)::int + (c is not null)::int >= 2""",
    "scale_standard": "select p_partkey, " + ", ".join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in ("p_size", "p_retailprice")) + " from part",
    "scale_minmax": "select p_partkey, " + ", ".join(f"round(({c} - min({c}) over ())::double / (max({c}) over () - min({c}) over ()), 6) as {c}" for c in ("p_size", "p_retailprice")) + " from part",
    "scale_robust": "select p_partkey, " + ", ".join(f"round(({c} - (select quantile_cont({c}, 0.5) from part)) / (select quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) from part), 6) as {c}" for c in ("p_size", "p_retailprice")) + " from part",
    "polynomial_features": """select p_partkey, p_size * p_size as poly_p_size_p_size, round(p_size * p_retailprice, 2) as poly_p_size_p_retailprice,
round(p_retailprice * p_retailprice, 2) as poly_p_retailprice_p_retailprice from part""",
    "interaction_features": "select p_partkey, round(p_size * p_retailprice, 2) as p_size_x_p_retailprice from part",
    "log_features": "select p_partkey, round(ln(p_size), 6) as log_p_size, round(ln(p_retailprice), 6) as log_p_retailprice from part",
    "remove_outliers_iqr": """with a as (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from lineitem),
x as (select lineitem.* from lineitem, a where l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
b as (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from x)
select count(*) as n, round(sum(l_extendedprice), 0) as total from x, b where l_quantity between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""",
    "remove_outliers_z": "with s as (select avg(value) as m, stddev_samp(value) as d from events) select count(*) as n, round(sum(value), 2) as total from events, s where abs(value - m) / d < 2",
    "anova_f": """with x as (select label, unnest(range(0, len(embedding))) as i, unnest(embedding)::double as x from embeddings), g as (select i, avg(x) as g from x group by i),
c as (select i, label, count(*) as n, avg(x) as m, sum(power(x, 2)) - count(*) * power(avg(x), 2) as ss from x group by i, label)
select 'e' || i as feature, round((sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 4) as f_score from c join g using (i) group by i""",
    "label_encode": "select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as code from orders",
    "stratified_split": """select vec_id, label, case when row_number() over (partition by label order by md5(vec_id::varchar), vec_id) <= ceil(count(*) over (partition by label) * 0.2::double) then 'test' else 'train' end as part from embeddings""",
    "visible_page": """select o_orderkey, o_totalprice from orders where (o_custkey % 10 = 1 or o_orderstatus = 'F') and o_orderpriority = '1-URGENT' order by o_totalprice, o_orderkey limit 50 offset 20""",
    "status_counts": "select count(*) filter (o_orderstatus = 'F') as completed, count(*) filter (o_orderstatus in ('O', 'P')) as active, count(*) filter (o_orderstatus = 'X') as failed from orders",
    "job_stats": """select o_custkey, count(*) as jobs, count(*) filter (o_orderstatus = 'F') as done, round(sum(o_totalprice) filter (o_totalprice > 0), 2) as total,
round(avg(o_totalprice) filter (o_totalprice > 0), 6) as mean from orders group by o_custkey""",
    "best_by_group": """select o_orderpriority, (array_agg(o_orderkey order by o_totalprice desc, o_orderkey))[1] as best, max(o_totalprice) as metric from orders group by o_orderpriority""",
    "knn_predict": """with q as (select vec_id as q, embedding as qv from embeddings where vec_id % 50 = 0),
p as (select q, vec_id as id, label, sqrt(list_sum(list_transform(range(1, len(qv) + 1), lambda i: power(qv[i]::double - embedding[i]::double, 2)))) as d from q, embeddings where vec_id <> q),
n as (select *, row_number() over (partition by q order by d, id) as k from p),
v as (select q, label, sum(1 / (d + 1e-9)) as vote from n where k <= 5 group by q, label)
select q, (array_agg(label order by vote desc, label))[1] as prediction from v group by q""",
}
_PRED = """pred as (select doc_id, quality as label, round(('0x' || md5(doc_id::varchar)[1:4])::bigint / 65536.0::double, 2) as score from labels),
p as (select *, (score >= 0.4)::int as prediction from pred)"""
ORACLES |= {
    "confusion": f"with {_PRED} select label, prediction, count(*) as n from p group by all",
    "weighted_scores": f"""with {_PRED}, c as (select l as label, count(*) filter (label = l) as actual, count(*) filter (label = l and prediction = l) as hit,
count(*) filter (prediction = l) as said from p, (select distinct label as l from p) group by l),
m as (select *, case when said > 0 then hit / said::double else 0 end as pr, hit / actual::double as r from c)
select round(sum(hit) / sum(actual)::double, 6) as accuracy, round(sum(pr * actual) / sum(actual), 6) as precision, round(sum(r * actual) / sum(actual), 6) as recall,
round(sum(case when pr + r > 0 then 2 * pr * r / (pr + r) else 0 end * actual) / sum(actual), 6) as f1 from m""",
    "roc_points": f"""with {_PRED}, s as (select score, sum(label) as pos, sum(1 - label) as neg from p group by score)
select score, round(sum(pos) over w / (select sum(label) from p)::double, 6) as tpr, round(sum(neg) over w / (select sum(1 - label) from p)::double, 6) as fpr from s
window w as (order by score desc rows unbounded preceding)""",
    "roc_auc": f"""with {_PRED}, x as (select sum(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end)::double as u from p a, p b where a.label = 1 and b.label = 0)
select round(u / ((select sum(label) from p) * (select sum(1 - label) from p))::double, 6) as auc from x""",
    "regression_scores": """with x as (select l_extendedprice as y, l_quantity * 1000 as f from lineitem), m as (select avg(power(y - f, 2)) as mse, avg(abs(y - f)) as mae, var_pop(y) as v from x)
select round(1 - mse / v, 4) as r2, round(mse, 4) as mse, round(sqrt(mse), 4) as rmse, round(mae, 4) as mae from m""",
}
