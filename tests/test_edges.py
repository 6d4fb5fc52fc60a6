"""Edge cases of the core operators, and models against plain computations."""

import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.catalog import everything
from helixframe.functions import protein as P
from helixframe.functions import sequence as S
from helixframe.ml import models as M
from helixframe.ml import sequence_models, training
from helixframe.operators import discovery, features, neighbours, ordered, prep, profile, scans, validation
from helixframe.sources import readers, sinks

SF = "/root/testdata/sf0.001"
ODD = [(0, ""), (1, "a"), (2, "ATG"), (3, "atgaaataa"), (4, "ATGNNNTAA"), (5, "A" * 700), (6, "ACGU-RYX*"), (7, None), (8, "ATGATGCCCTAGATGTGA")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "seq_idx long, sequence string")


def test_odd_sequences_do_not_crash(spark, odd):
    none = odd.limit(0)
    for rows in (odd.where("sequence is not null"), odd, none):
        scans.motif_hits(rows).count(), scans.orfs(rows).count(), scans.cpg_islands(rows).count(), scans.six_frame_proteins(rows).count()
        validation.nucleotide_quality(rows).count(), validation.missing_sequences(rows).count(), features.feature_table(rows).count()
        features.evolution_features(rows).count(), discovery.pathogen_signatures(rows).count()
        scans.kmers(rows, 3).count(), scans.drug_proteins(rows).count(), discovery.motif_totals(rows).count()
    assert validation.missing_sequences(odd).first().asDict() == {"empty": 2, "all_n": 0, "mostly_gaps": 0}


def test_orfs_equal_a_walk(spark, odd):
    def walk(s):
        for m in re.finditer("(?=ATG)", s):
            for j in range(m.start() + 3, len(s) - 2, 3):
                if s[j : j + 3] in ("TAA", "TAG", "TGA"):
                    yield m.start(), j + 3
                    break

    got = {(r["seq_idx"], r["start"], r["end"]) for r in scans.orfs(odd).collect()}
    assert got == {(i, a, b) for i, s in ODD if s for a, b in walk(s)} and len(got) == 4


def test_a_million_bases_within_a_minute(spark):
    s = "".join(np.random.default_rng(1).choice(list("ACGT"), 1_000_000))
    rows = spark.createDataFrame([(0, s)], "seq_idx long, sequence string")
    began = time.time()
    counts = discovery.gene_totals(rows).first(), scans.motif_hits(rows).count(), scans.kmers(rows, 4).count(), scans.cpg_islands(rows).count()
    assert counts[2] == 999_997 and counts[0]["orfs"] > 50_000 and time.time() - began < 60


def test_fasta_preambles_and_comments(spark, tmp_path):
    for name, text in (("a.fa", "junk before\n>a x\nAC\n# note\nGT\n>b\n\nTT"), ("b.fa", ">c y|tumor\nAA\n"), ("c.fa", "# only a comment\n\n>d\nCC"), ("e.fa", "")):
        (tmp_path / name).write_text(text)
    got = {r["id"]: (r["sequence"], r["label"]) for r in readers.fasta(spark, str(tmp_path)).collect()}
    assert got == {"a": ("ACGT", "x"), "b": ("TT", "unknown"), "c": ("AA", "affected" if "tumor" in "y|tumor" else ""), "d": ("CC", "unknown")}


def test_readers_and_configs():
    assert readers.validate_upload("x.exe", 1) and not readers.validate_upload("x.fasta", 1) and readers.validate_upload("x.csv", 1 << 40)
    config = training.config("random_forest", 500)
    assert all(sinks.config_from(sinks.config_text(config, k), k) == config for k in ("json", "yaml"))
    assert validation.config_errors({"a": 1}, {"a": str, "b": int}) == ["a is no str", "b is missing"]
    assert all(set(g) for g in training.GRIDS.values())


def test_isoelectric_points_balance_charge(spark):
    def charge(p, ph):
        from helixframe import constants as C

        up = [(p.count(k), v) for k, v in C.POSITIVE_PK.items()] + [(1, C.N_END_PK_OF.get(p[0], C.N_END_PK))]
        down = [(p.count(k), v) for k, v in C.NEGATIVE_PK.items()] + [(1, C.C_END_PK_OF.get(p[-1], C.C_END_PK))]
        return sum(n / (10 ** (ph - k) + 1) for n, k in up) - sum(n / (10 ** (k - ph) + 1) for n, k in down)

    names = ["MKKLD", "ACDEFGHIKLMNPQRSTVWY", "DDDE", "GAVL", "M*"]
    rows = spark.createDataFrame([(p,) for p in names], "p string").select("p", P.isoelectric_point(F.col("p")).alias("x")).collect()
    for r in rows[:-1]:
        at_edge = r["x"] < 4.06 or r["x"] > 11.99
        assert at_edge or abs(charge(r["p"], r["x"])) < 0.01
    assert rows[-1]["x"] == 7.0


def greedy(sizes, many, letters):
    """(sequence, chunk, batch) by a walk."""
    want, number, held, total = [], 0, 0, 0
    for i, n in enumerate(sizes):
        if n > letters:
            if held:
                number += 1
            held = total = 0
            for k in range(-(-n // letters)):
                want.append((i, k + 1, number))
                number += 1
            continue
        if held and (held >= many or total + n > letters):
            number, held, total = number + 1, 0, 0
        want.append((i, None, number))
        held, total = held + 1, total + n
    return want


@pytest.mark.parametrize("rows, width, many, letters", [(150, 1 << 16, 5, 800), (150, 7, 5, 800), (150, 5, 5, 5000), (100_000, 2000, 100, 40_000), (100_000, 1 << 16, 100, 900), (3, 1, 1, 10)])
def test_batches_follow_the_greedy_rule(spark, monkeypatch, rows, width, many, letters):
    """In one range and in many, up to 100,000 sequences, some of them large."""
    monkeypatch.setattr(discovery, "RANGE", width)
    sizes = np.random.default_rng(2).integers(0, 905, rows).tolist()
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "seq_idx long, n int").select("seq_idx", F.repeat(F.lit("A"), F.col("n")).alias("sequence"))
    got = sorted((tuple(r) for r in discovery.greedy_batches(frame, many, letters).collect()), key=lambda r: (r[0], r[1] or 0))
    assert got == greedy(sizes, many, letters)
    if rows == 150:
        assert discovery.chunks(frame, 800).agg(F.sum(F.length("sequence"))).first()[0] == sum(sizes)
        assert discovery.greedy_batches(frame.limit(0), many, letters).count() == 0


def test_rollup_of_batches_equals_a_walk(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(0, 700, 40)] + ["ATG" + "GCC" * 400 + "TAA", ""]
    pieces = defaultdict(list)
    for i, chunk, batch in greedy([len(t) for t in texts], 6, 900):
        pieces[batch].append(texts[i][900 * (chunk - 1) : 900 * chunk] if chunk else texts[i])
    total = kept = long = letters = 0
    for batch in pieces.values():
        size = sum(map(len, batch))
        least = max(60, int(size / len(batch) * 0.3)) if size < 50_000 else 300
        for s in batch:
            for strand in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))):
                for frame in range(3):
                    t = strand[frame:]
                    for m in re.finditer("(?=ATG)", t):
                        stop = next((j + 3 for j in range(m.start() + 3, len(t) - 2, 3) if t[j : j + 3] in ("TAA", "TAG", "TGA")), None)
                        if stop:
                            total += 1
                            if stop - m.start() >= least:
                                kept, letters, long = kept + 1, letters + stop - m.start(), long + (stop - m.start() >= 1000)
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, sequence string")
    got = {r["metric"]: r["value"] for r in discovery.batch_rollup(rows, many=6, letters=900).collect()}
    assert (got["total_orfs_found"], got["protein_coding_orfs"], got["long_orfs"], got["batches"]) == (total, kept, long, max(pieces) + 1)
    assert got["average_orf_length"] == pytest.approx(letters / kept) and kept > 50


def test_running_sums_equal_a_list(spark):
    values = np.random.default_rng(6).integers(0, 9, 500).tolist()
    rows = spark.createDataFrame([(i, v, None if v == 4 else v) for i, v in enumerate(values)], "id long, v int, w int").repartition(7)
    got = {r["id"]: (r["at"], r["sum"]) for r in ordered.running(ordered.running(rows, ["v", "id"]), ["v", "id"], "w", "sum").collect()}
    order = sorted(range(500), key=lambda i: (values[i], i))
    total, want = 0, {}
    for k, i in enumerate(order):
        want[i] = (k, total)
        total += 0 if values[i] == 4 else values[i]
    assert got == want and ordered.running(rows.limit(0), ["v", "id"]).count() == 0


def test_linear_scans_take_twice_the_time_for_twice_the_letters(spark):
    """Windows and words of half a million and of a million letters; a quadratic scan would take four times as long."""
    s = "".join(np.random.default_rng(1).choice(list("ACGT"), 1_000_000))
    took = []
    for n in (500_000, 500_000, 1_000_000):
        rows = spark.createDataFrame([(0, s[:n])], "seq_idx long, sequence string")
        began = time.time()
        scans.cpg_islands(rows).collect(), features.evolution_features(rows).collect(), features.dense_kmers(rows, 3).count()
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 2


def test_tables_of_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 1.0, "b"), (3, 1.0, "a"), (4, 3.0, None)], "id long, x double, t string")
    p = profile.column_profile(rows, ["x"]).first()
    assert (p["n"], p["missing"], p["distinct"], p["q25"], p["q50"], p["q75"]) == (3, 1, 2, 1.0, 1.0, 2.0)
    assert {r["id"]: r["code"] for r in prep.label_encode(rows, "t").collect()} == {1: None, 2: 1, 3: 0, 4: None}
    none = rows.limit(0)
    assert profile.column_profile(none, ["x"]).count() == 0 and prep.label_encode(none, "t").count() == 0
    assert neighbours.nearest(none.select("id", F.array("x").alias("vector")), none.select(F.col("id").alias("q"), F.array("x").alias("qv")), 3).count() == 0
    done, failed = prep.run_batch({"a": rows, "b": rows.drop("x")}, [("drop_missing", {"subset": ["x"]})])
    assert done["a"].count() == 3 and set(failed) == {"b"}
    with pytest.raises(ValueError):
        prep.run_steps(rows, [("no such step", {})])


def test_projection_and_linear_model_equal_numpy(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], float)
    got = np.array([r["pc"] for r in M.principal_components(M.embedded(e), 2).orderBy("id").collect()])
    centred = x - x.mean(0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    want = centred @ v[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    parts = np.array([r["contributions"] for r in everything.QUERIES["linear_shap"](spark, SF).orderBy("id").collect()])
    p = spark.read.parquet(f"{SF}/part.parquet").orderBy("p_partkey").toPandas()
    design = np.c_[np.ones(len(p)), p["p_size"], p["p_partkey"]]
    weights = np.linalg.lstsq(design, p["p_retailprice"].to_numpy(float), rcond=None)[0]
    assert np.allclose(parts.sum(1) + p["p_retailprice"].astype(float).mean(), design @ weights, atol=1e-3)


def test_clusters_are_nearest_to_their_own_centre(spark):
    e = M.embedded(spark.read.parquet(f"{SF}/embeddings.parquet"))
    got = {r["id"]: r["cluster"] for r in M.clusters(e, 4).collect()}
    x = {r["id"]: r["raw"].toArray() for r in e.collect()}
    centre = {c: np.mean([x[i] for i in got if got[i] == c], axis=0) for c in set(got.values())}
    near = [min(centre, key=lambda c: np.linalg.norm(x[i] - centre[c])) == got[i] for i in got]
    assert np.mean(near) > 0.97


def test_sequence_models_learn_a_marked_class(spark):
    s = everything.QUERIES and __import__("helixframe.catalog.model_queries", fromlist=["labelled"]).labelled(spark, SF)
    got = sequence_models.model("gene_classifier", 10, 5).fit(s).predict(s).join(s.select("seq_idx", "label"), "seq_idx")
    assert got.where("prediction = label").count() / got.count() > 0.9
    with pytest.raises(ValueError):
        sequence_models.model("none")
    with pytest.raises(ValueError):
        training.predict(None, s, ["missing"])


def test_scalars_by_hand(spark):
    row = spark.createDataFrame([("ATGAAATAAC", "ATGGAGTGA", "")], "a string, b string, e string").select(
        S.inframe_orfs(F.col("a")).alias("o"), S.translate_to_stop(F.col("b")).alias("p"), S.codon_bias(F.col("e")).alias("z"), S.client_type(F.col("e")).alias("t"),
        S.quality_issues(F.lit("AN-Z")).alias("q"),
    ).first()
    assert (row["o"]["longest"], row["o"]["orfs"], row["p"], row["z"], row["t"]) == (9, 1, "ME", 0.0, "DNA")
    assert row["q"] == ["Contains 1 ambiguous bases", "Contains 1 gaps", "Contains 1 invalid characters", "Very short sequence (4 bp)"]
