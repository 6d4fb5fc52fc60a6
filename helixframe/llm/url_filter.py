"""URL filter: rules as a sorted array of 64-bit digests in one file, which every executor maps into memory.

A url is looked up by the digests of its host's suffixes joined with prefixes of its path, of lengths that rules have, by a
binary search over all candidates of a batch. Where a digest is found, the stored rule itself is compared, so digests that
collide do no harm.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import shared_folder

#: Spark's seed of xxhash64; bytes of the rules that an index may hold, as every executor keeps a copy; bytes written at once.
SEED, MAX_BYTES, WRITTEN = 42, 1 << 30, 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The file's end: rules, bytes of their text, bits of a digest.
FOOT = struct.Struct("<qqq")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and the path (then up to ``?``, ``#``
    or the end); both empty for a null url or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class Index:
    """The mapped file: the rules' text one after the other, then digests in order, ends of text, lengths of hosts, verdicts, foot."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, size, self.bits = FOOT.unpack(raw[-FOOT.size :].tobytes())
        part = lambda k: raw[size + 8 * n * k : size + 8 * n * (k + 1)].view(np.int64)
        self.text, self.blocks = raw[:size], raw[size + 24 * n : size + 25 * n]
        self.digests, self.ends, self.hosts = (np.frombuffer(part(k), np.int64) for k in range(3))
        # Of each length of host that rules have, the lengths of their paths.
        whole = np.diff(self.ends, prepend=0)
        self.lengths: dict[int, list[int]] = {}
        for h, p in np.unique(np.c_[self.hosts, whole - self.hosts], axis=0).tolist():
            self.lengths.setdefault(h, []).append(p)
        self.longest = max(self.lengths, default=0)

    def digest(self, key: bytes) -> int:
        x = xxhash.xxh64_intdigest(key, SEED)
        return masked(x - (1 << 64) if x >> 63 else x, self.bits)

    def rule(self, k: int) -> bytes:
        return self.text[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()

    def suffixes(self, host: bytes) -> Iterator[bytes]:
        """The host and its parent domains, of lengths that rules have."""
        tail = host[-self.longest - 1 :]
        at = -1
        if len(tail) <= self.longest and len(host) in self.lengths:
            yield host
        while (at := tail.find(b".", at + 1)) >= 0:
            if len(tail) - at - 1 in self.lengths:
                yield tail[at + 1 :]

    def judge(self, hosts: pd.Series, paths: pd.Series) -> tuple[list, list]:
        """Of each url the longest rule that fits, or None, and whether it blocks; of rules of one length that of the longer host wins."""
        owner, keys, seen = [], [], {}
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if host not in seen:
                seen[host] = list(self.suffixes(host.encode()))
            if not seen[host]:
                continue
            raw = path.encode()
            for end in seen[host]:
                fit = [end + raw[:p] for p in self.lengths[len(end)] if p <= len(raw)]
                keys += fit
                owner += [i] * len(fit)
        best: list = [None] * len(hosts)
        if keys:
            want = np.array([self.digest(k) for k in keys], np.int64)
            at = np.searchsorted(self.digests, want)
            for c in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == want).tolist():
                k = int(at[c])
                while k < len(self.digests) and self.digests[k] == want[c]:
                    if self.rule(k) == keys[c]:
                        i, rule = owner[c], keys[c].decode()
                        rank = (len(rule), int(self.hosts[k]))
                        if best[i] is None or rank > best[i][0]:
                            best[i] = (rank, rule, bool(self.blocks[k]))
                    k += 1
        return [b and b[1] for b in best], [b and b[2] for b in best]


def masked(digest: int, bits: int) -> int:
    """The low bits of a digest; fewer than 64 only make collisions."""
    return digest if bits == 64 else digest & ((1 << bits) - 1)


def store_index(spark: SparkSession, rules: DataFrame, bits: int = 64) -> str:
    """Write the rules (columns rule and verdict, ``block`` or ``allow``) as one file, hand it to all executors, return its name.

    A rule is a host, then a path from the first ``/`` on; A-Z of hosts are lower-cased. Null rules and rules without a host fit no
    url and are left out. A rule that is given with both verdicts blocks. Spark sorts the rules; the driver copies them into
    the file partition by partition, so it holds 25 bytes a rule. Over MAX_BYTES of rules raise an error.
    """
    text = F.col("rule")
    host = F.translate(F.regexp_extract(text, r"^([^/]*)", 1), UPPER, LOWER)
    own = rules.select(host.alias("host"), F.regexp_extract(text, r"(?s)^[^/]*(.*)$", 1).alias("path"), (F.col("verdict") == "block").alias("block"))
    own = own.where("host <> ''").groupBy("host", "path").agg(F.coalesce(F.max("block"), F.lit(False)).alias("block"))
    digest = F.xxhash64(F.concat("host", "path"))
    digest = digest if bits == 64 else digest.bitwiseAND(F.lit((1 << bits) - 1))
    own = own.select(digest.alias("digest"), F.encode(F.concat("host", "path"), "UTF-8").alias("key"), F.octet_length("host").alias("n"), "block")
    many, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    if size > MAX_BYTES:
        raise ValueError(f"{size} bytes of rules pass the {MAX_BYTES} that each executor may hold")
    numbers, blocks = np.zeros((3, many), np.int64), np.zeros(many, np.uint8)
    sc = spark.sparkContext
    target = f"{shared_folder(spark)}/urls-{uuid.uuid4().hex}.index"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        held, end = bytearray(), 0
        for k, r in enumerate(own.orderBy("digest", "key").toLocalIterator()):
            held += r["key"]
            end += len(r["key"])
            numbers[:, k], blocks[k] = (r["digest"], end, r["n"]), r["block"]
            if len(held) >= WRITTEN:
                out.write(held)
                held = bytearray()
        held += bytes(-end % 8)  # what follows lies on whole numbers, so that it is searched where it is mapped
        size = end + -end % 8
        tail = memoryview(bytes(held) + numbers.tobytes() + blocks.tobytes() + FOOT.pack(many, size, bits))
        for at in range(0, len(tail), WRITTEN):
            out.write(bytearray(tail[at : at + WRITTEN]))
    finally:
        out.close()
    sc.addFile(target)
    return target.rsplit("/", 1)[1]


def judge(pages: DataFrame, rules: DataFrame, column: str = "url", default: str = "allow", bits: int = 64) -> DataFrame:
    """The input's columns with host, path, rule and verdict of each row's url; columns of these names are replaced.

    A rule fits its host and all subdomains of it, if the url's path starts with the rule's; the longest rule wins. Without one the
    rule is null and the verdict ``default``, also for a null url, an empty one and one without ``://``. Repeated rows are judged
    alike; an empty table gives no rows, and no rules leave ``default``. No row is moved: every task maps the file of rules.
    """
    name = store_index(pages.sparkSession, rules, bits)

    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = Index(SparkFiles.get(name))
        for hosts, paths in batches:
            rule, blocks = index.judge(hosts, paths)
            yield pd.DataFrame({"rule": rule, "verdict": [default if b is None else "block" if b else "allow" for b in blocks]}, dtype=object)

    look.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(look, "rule string, verdict string")
    own = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(column))
    rows = pages.select(*[c for c in pages.columns if c not in own], host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", found("host", "path"))
    return rows.select(*[c for c in rows.columns if c != "rule"], F.col("rule.rule").alias("rule"), F.col("rule.verdict").alias("verdict"))


def oracle(rules: list[tuple[str, str]]) -> str:
    """DuckDB SQL of ``judge`` over ``pages``: every url against every rule."""
    values = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    return f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from u),
p as (select page_id, translate(raw, '{UPPER}', '{LOWER}') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from h),
r(rule, rule_host, rule_path, verdict) as (values {values}),
fit as (select page_id, rule, verdict, row_number() over (partition by page_id, host, path order by length(rule) desc, length(rule_host) desc) k
        from p join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') verdict from p left join fit on fit.page_id = p.page_id and fit.k = 1"""
