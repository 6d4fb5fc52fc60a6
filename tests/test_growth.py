"""Work and memory that grow with the input: forms of plans, and results on long or odd rows against plain walks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import features, neighbours, scans
from helixframe.sources import readers, sinks

STOPS = ("TAA", "TAG", "TGA")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def orfs_of(s: str) -> tuple[int, int]:
    longest, many = 0, 0
    for k in range(3):
        at = None
        for i in range(k, len(s) - 2, 3):
            c = s[i : i + 3]
            if at is None and c == "ATG":
                at = i
            elif at is not None and c in STOPS:
                longest, many, at = max(longest, i + 3 - at), many + 1, None
    return longest, many


def bias_of(s: str) -> float:
    known = [s[i : i + 3] for i in range(0, len(s) - 2, 3) if set(s[i : i + 3]) <= set("ACGT")]
    return min(2 * max(map(known.count, set(known))) / len(known), 1.0) if len(s) % 3 == 0 and known else 0.0


def shares_of(s: str) -> tuple[float, float]:
    n = len(s)
    if n < 6:
        return 0.0, 0.0
    repeats = sum(s[i : i + 2] == s[i + 2 : i + 4] for i in range(n - 3))
    return min(2 * repeats / n, 1.0), max([0.0] + [sum(s[i] == s[i + d] for i in range(n - d)) / (n - d) for d in (1, 2, 3) if d < n // 2])


def test_structural_features_run_no_function_a_letter(spark):
    """F10, F16: one pass of a pattern instead of a lambda for each letter or codon, with the results of a walk, on sequences of any length."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("ACGT", k=rng.randrange(60))) for _ in range(300)] + ["".join(rng.choices("ATGN\n", k=90)) for _ in range(100)]
    texts += ["ATGATGTAATAAATGTGA", "ATGCC", "", "ATG" * 20_000, "ATG" + "GCC" * 50_000 + "TAG", "\U0001f600ATGTAA", "AAAAAA", "ACACACAC"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    s = F.col("s")
    o = S.inframe_orfs(s)
    out = rows.select("i", o["longest"].alias("longest"), o["orfs"].alias("orfs"), S.codon_bias(s).alias("bias"), S.repeat_score(s).alias("repeat"), S.periodicity(s).alias("period"), S.codons(s).alias("codons"))
    for r in out.collect():
        t = texts[r["i"]]
        assert (r["longest"], r["orfs"]) == orfs_of(t) and abs(r["bias"] - bias_of(t)) < 1e-12
        assert max(abs(x - y) for x, y in zip((r["repeat"], r["period"]), shares_of(t))) < 1e-12
        assert r["codons"] == [t[i : i + 3] for i in range(0, len(t) - 2, 3) if set(t[i : i + 3]) <= set("ACGT")]
    none = spark.createDataFrame([(None,)], "s string").select(o["longest"].alias("a"), o["orfs"].alias("b"), S.shifted_matches(s, 1, 1).alias("c")).first()
    assert tuple(none) == (None, None, None)
    plan = plan_of(out)
    assert not any(f"{name}(" in plan for name in ("aggregate", "zip_with", "filter"))


def test_fasta_features_deal_no_records(spark, tmp_path):
    """neither the records of a file nor the words of a record are gathered in one task."""
    texts = ["ACGACGNACG", "AAAA", "ac", "NNNN", "TTTACG" * 40]
    for k in range(2):
        (tmp_path / f"{k}.fasta").write_text("preamble\n" + "".join(f">s{k}{i} normal\n{t}\n" for i, t in enumerate(texts)))
    for words in (["AAA", "ACG", "TTT", "GGG"], None):
        out = sinks.fasta_features(readers.fasta(spark, str(tmp_path)), 3, words)
        got = {r["id"]: r.asDict() for r in out.collect()}
        own = [Counter(w for j in range(len(t) - 2) if set(w := t.upper()[j : j + 3]) <= set("ACGT")) for t in texts]
        seen = words or sorted(set().union(*own))
        assert len(got) == 10 and [c for c in out.columns if c.startswith("kmer_")] == [f"kmer_{w}" for w in seen]
        for k in range(2):
            for i, c in enumerate(own):
                row = got[f"s{k}{i}"]
                assert [row[f"kmer_{w}"] for w in seen] == [c[w] / sum(c.values()) if c[w] else None for w in seen]
    plan = plan_of(out)
    assert "SortMergeJoin" not in plan and "Window" not in plan


def test_vocabulary_shares_need_no_shuffle(spark):
    """each sequence's words are counted in its own row."""
    texts = ["ACGACGNACG", "AAAA", "", "ac", None, "AC\nACG"]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_idx long, sequence string")
    out = features.vocabulary_frequencies(rows, {3: ["ACG", "AAA"], 4: []}, 3)
    got = {r["seq_idx"]: r for r in out.collect()}
    assert [list(got[i]["kmer_3"]) for i in range(6)] == [[3 / 5, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [1, 0, 0]]
    assert all(list(r["kmer_4"]) == [0, 0, 0] for r in got.values())
    assert "Exchange" not in plan_of(out)


def test_numbers_of_kmers_stand_for_all(monkeypatch):
    """k-mers across the pieces of a long text and up to 31 letters, none across texts."""
    monkeypatch.setattr(scans, "NUMBERED", 7)
    rng = random.Random(5)
    texts = ["".join(rng.choices("ACGTN\u00e9\U0001f600", weights=[9, 9, 9, 9, 1, 1, 1], k=rng.randrange(90))) for _ in range(60)] + [None, ""]
    for k in (1, 3, 31):
        got = Counter((i, w) for row, number in scans.numbered_kmers(texts, k) for i, w in zip(row.tolist(), scans.kmer_of(number, k)))
        assert got == Counter((i, t[j : j + k]) for i, t in enumerate(texts) if t for j in range(len(t) - k + 1) if set(t[j : j + k]) <= set("ACGT"))
    assert all(scans.kmer_of(np.array([scans.kmer_number(w)]), len(w))[0] == w for w in ("A", "GATTACA", "T" * 31))


def test_a_full_block_of_neighbours_takes_little_memory():
    """the largest block that a task compares, with the results of all pairs."""
    rng = np.random.default_rng(2)
    n = neighbours.BLOCK
    x = rng.random((n + 40, 64))
    group = pd.DataFrame({"key": np.arange(n + 40), "v": list(x), "asks": np.r_[np.zeros(n, int), np.ones(40, int)]})
    tracemalloc.start()
    got = neighbours._best(group, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.sqrt(((x[n:, None] - x[None, :n]) ** 2).sum(2))
    assert got["id"].tolist() == np.argsort(d, 1, kind="stable")[:, :5].ravel().tolist()
    assert most < 64 << 20
