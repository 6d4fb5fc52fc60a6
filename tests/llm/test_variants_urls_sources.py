"""Spelling variants, url rules and source divergence against plain computations."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import queries as llm
from helixframe.llm import source_divergence, spelling_variants, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, word string, n long, side int, term string, p long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "z", 7, 8, "t", 9) for r in rows], DOCS)


def plain_variants(docs, slips):
    """Every word against every other of a length within one."""
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if slips and h % 31 == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    # Words one letter apart share the word without one letter at a place, or one is the other without a letter.
    less = defaultdict(set)
    for w in words:
        for p in range(len(w)):
            less[w[:p] + w[p + 1 :], p].add(w)
            if (short := w[:p] + w[p + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in less.values():
        for a in group:
            near[a] |= group - {a}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants_of(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_variants_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()], True)
    assert variants_of(llm.op11_anagram_variants(spark, f"/root/testdata/{sf}")) == want
    assert sum(w[0] is not None for w in want.values()) >= 10


def test_variants_of_odd_words(spark, monkeypatch):
    """Equal letters in other orders, repeated letters, words of 5,000 letters, chains of forms, ties, nulls, repeated rows; in small pieces too."""
    letters = "abcdefg\u00e9\u00ff\u00d7"
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(letters[:k]), n)) for k in (2, 4, 10) for n in (7, 8, 9) for _ in range(60)]
    long = "".join(rng.choice(list("abc"), 5000))
    words += [long, long[:40] + long[41:], long[:9] + "d" + long[10:], long + "c", long[::-1]]
    text = " ".join(w for w in words for _ in range(2))
    chain = " ".join([*["formally"] * 500, *["formaly"] * 40, *["fornaly"] * 3, *["FORMALL\u00c9"] * 2, *["formall\u00e9"] * 2, *["formalli"] * 500])
    rows = [(1, text), (1, text), (2, chain), (None, chain.upper() + " \u0161formaly \u4e2dformaly"), (3, None), (4, ""), (5, "short " * 50), (6, chain)]
    want = plain_variants(rows, False)
    assert want["fornaly"][:2] == ("formaly", "formally") and want["formall\u00e9"][0] == "formalli"
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert variants_of(spelling_variants.variants(docs)) == want
    monkeypatch.setattr(spelling_variants, "PIECE", 40)
    monkeypatch.setattr(spelling_variants, "HELD", 30)
    monkeypatch.setattr(spelling_variants, "SENT", 100)
    assert variants_of(spelling_variants.variants(docs, slips=True)) == plain_variants(rows, True)
    assert variants_of(spelling_variants.variants(docs.limit(0))) == {}
    with pytest.raises(ValueError):
        spelling_variants.variants(docs, times=1)


def parts(url):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def plain_verdict(url, rules):
    host, path = parts(url)
    fit = []
    for rule, verdict in rules:
        own, slash, rest = rule.partition("/")
        own = "".join(c.lower() if c.isascii() else c for c in own)
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            fit.append((len(own + slash + rest), len(own), verdict == "block", own + slash + rest))
    best = max(fit, default=None)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else "allow"


@pytest.mark.parametrize("bits", [64, 3])
def test_url_rules_equal_every_rule_tried(spark, bits):
    """Random urls under random rules; with 3 bits nearly all digests collide."""
    rng = np.random.default_rng(5)
    label, step = ["a", "b", "net", "example", "\u00e9x", "x-1"], ["", "en", "de", "en/de", "\u00e9", "e"]
    name = lambda: ".".join(rng.choice(label, rng.integers(1, 4)))
    rules = [(name() + rng.choice(["", "/"]) + rng.choice(step), str(rng.choice(["allow", "block"]))) for _ in range(120)] + [("A.Net/EN", "block")]
    rules = [(r, v) for r, v in rules if "/" in r or not r.endswith(tuple(s for s in step if s))]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{name()}{rng.choice(['', '/', '?', '#', ':80/'])}{rng.choice(step)}{rng.choice(['', '/', '?q=/en', '#://x'])}" for _ in range(600)]
    urls += [None, "", "no scheme/en", "://", ":///en", "http://a.net", "http://A.NET/EN", "http://a.net/en\n/x", "x://" + "a." * 3000 + "net/en" + "e" * 5000, "http://x?u=http://a.net/", urls[0], urls[0]]
    frame = spark.createDataFrame([(i, u, "old", "k") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string")
    given = spark.createDataFrame([*rules, (None, "block"), ("", "block"), ("/en", "block")], "rule string, verdict string")
    got = url_filter.judge(frame, given, bits=bits)
    assert set(got.columns) == {"page_id", "url", "key", "host", "path", "rule", "verdict"}
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    want = {i: plain_verdict(u, rules) for i, u in enumerate(urls)}
    assert rows == want and 100 < sum(w[2] is not None for w in want.values()) < 700
    assert url_filter.judge(frame.limit(0), given).count() == 0
    assert {r["verdict"] for r in url_filter.judge(frame, given.limit(0)).select("verdict").collect()} == {"allow"}


def test_rules_have_a_size_bound(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BYTES", 3)
    with pytest.raises(ValueError):
        url_filter.store_index(spark, spark.createDataFrame([("example.net/", "block")], "rule string, verdict string"))


def plain_audit(docs, least, top):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in docs]
    within, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, t in terms:
        within[lang].update(set(t))
        count[lang, source].update(t)
    out = []
    shares = {}
    for lang in within:
        kept = [t for t, n in within[lang].items() if n >= least]
        mine = [s for x, s in count if x == lang]
        whole = Counter()
        for s in mine:
            whole.update({t: count[lang, s][t] for t in kept})
        for s, c in [*((s, count[lang, s]) for s in mine), (None, whole)]:
            total = sum(c[t] for t in kept)
            shares[s] = {t: 1 + int(Fraction(10**9 * (c[t] + 5), total + 5 * len(kept))) for t in kept}
        for s in mine:
            pair = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pair, 1)]
            term = sorted((shares[None][t] - shares[s][t], t.encode(), t) for t in kept if count[lang, s][t] and shares[s][t] > shares[None][t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(term[:top], 1)]
    return sorted(out)


def audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit_equals_plain_sums(spark, monkeypatch):
    """Many sources of few terms and many of them, over several tile sides; groups without terms; nulls; a lang of one source; small pieces."""
    rng = np.random.default_rng(9)
    vocab = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)] + ["\u00e9t\u00e9", "\u4e2d\u6587", "A\u0130B"]
    rows = []
    for k in range(260):
        lang, source = str(rng.choice(["x", "y"])), f"s{rng.integers(23)}"
        words = np.minimum(rng.zipf(1.3, rng.integers(0, 60)) - 1, len(vocab) - 1)
        rows.append((k, rng.choice([" ", "\n", "1", "_"]).join(vocab[w].upper() if w % 3 else vocab[w] for w in words), lang, source))
    rows += [(1, None, "x", "empty"), (1, "", "x", "empty"), (2, "12 __ 3", "z", "only"), (3, "tab tab", None, None), (None, "tab", "w", "a"), (None, "tab", "w", "b"), (4, "tab " * 3000, "x", "s1")]
    want = plain_audit([r[1:] for r in rows], 3, 5)
    docs = documents(spark, rows)
    assert audited(source_divergence.audit(docs, 3, 5)) == want
    for name, value in (("SIDE", 5), ("SALTS", 3), ("HELD", 50), ("PIECE", 9), ("HEAVY", 3)):
        monkeypatch.setattr(source_divergence, name, value)
    assert audited(source_divergence.audit(docs, 3, 5)) == want
    assert {w[0] for w in want} >= {"x", "y", "w"} and sum(w[2] == "pair" for w in want) > 900
    assert audited(source_divergence.audit(docs.limit(0))) == []


@pytest.mark.parametrize("name", ["op12_url_digests", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(llm.oracle_sql()[name])
    order = [d[0] for d in want.description]
    got = llm.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(order)
    assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.fetchall()))
