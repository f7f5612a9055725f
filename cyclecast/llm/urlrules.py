"""URL rules by a sort-merge range join.

A host read from its last label on is a key under which a host and its subdomains are one interval:
``org.example.`` stands before ``org.example.blog.``, and both lie in that of ``org.``. Rules and
URLs are sorted by that key together; a sweep keeps a stack of the rules whose interval is open,
nested ones on top, and each of them its path prefixes, nested as well.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclecast.llm.common import fresh

#: Keys that are sampled per partition to choose where the sorted order is cut, and at most.
SAMPLE, MOST = 40, 40_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """The stack of open rules while keys rise."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, list[str], list[int], list[str], list[str]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        """Rules of one key come by rising path; of equal ones ``block`` wins."""
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, len(host), [], [], [], []))
        _, _, paths, parents, names, verdicts = self.stack[-1]
        if paths and paths[-1] == path:
            verdicts[-1] = max(verdicts[-1], verdict)
            return
        above = len(paths) - 1
        while above >= 0 and not path.startswith(paths[above]):
            above = parents[above]
        paths.append(path), parents.append(above), names.append(host + path), verdicts.append(verdict)

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict; of equally long ones that of the longer host."""
        self._close(key)
        best, found = (-1, -1), (None, None)
        for _, size, paths, parents, names, verdicts in self.stack:
            at = bisect_right(paths, path) - 1
            while at >= 0 and not path.startswith(paths[at]):
                at = parents[at]
            if at >= 0 and (len(names[at]), size) >= best:
                best, found = (len(names[at]), size), (names[at], verdicts[at])
        return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """The columns of ``pages`` with host, path, rule and verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path starts
    with its path; the longest wins, and without one the verdict is ``default`` and rule is null. The
    sorted order is cut at keys of a bounded sample, by row where a URL is repeated, so no host or URL
    fills a task; a rule goes to each part that its interval meets, so no part needs its neighbour.
    Null URLs, and those without ``://``, have an empty host and path, which rules may not fit. Rules
    with a null are no rules. A name that ``pages`` has gets an underscore.
    """
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [fresh(pages, c) for c in ("host", "path", "rule", "verdict")]
    kept = pages.columns
    tie = F.pmod(F.xxhash64(F.col(url_col), *(c for c, t in pages.dtypes if t in ("bigint", "int", "string") and c != url_col)), F.lit(1 << 30))
    urls = pages.select(F.struct(*pages.columns).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), tie.alias("tie"))
    urls = urls.select("row", "host", "path", "tie", key_of(F.col("host")).alias("key"))
    drawn = urls.select("key", "path", "tie").orderBy(F.xxhash64("tie", "path"), "key", "path", "tie").limit(min(SAMPLE * n, MOST)).collect()
    drawn = sorted((r.key, r.path, r.tie) for r in drawn)
    cuts = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "tie")))
            yield batch.append_column("part", pa.array([bisect_right(cuts, k) for k in keys], pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                to = range(bisect_right(cuts, (key, "", -1)), bisect_right(cuts, (key + _LAST, _LAST, 1 << 30)) + 1)
                rows += [i] * len(to)
                parts += to
            yield batch.take(pa.array(rows, pa.int64())).append_column("part", pa.array(parts, pa.int32()))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_rules = None, Sweep()
        for batch in batches:
            cells = [batch.column(c).to_pylist() for c in ("part", "key", "path", "host", "set")]
            is_url, rule, verdict = [], [], []
            for part, key, path, host, decided in zip(*cells):
                if part != now:
                    now, open_rules = part, Sweep()
                is_url.append(decided is None)
                if decided is not None:
                    open_rules.rule(key, host, path, decided)
                else:
                    found, said = open_rules.find(key, path)
                    rule.append(found)
                    verdict.append(said or default)
            out = batch.select(["row", "host", "path"]).filter(pa.array(is_url))
            yield out.append_column("rule", pa.array(rule, pa.string())).append_column("verdict", pa.array(verdict, pa.string()))

    placed = urls.mapInArrow(place, T.StructType([*urls.schema, T.StructField("part", T.IntegerType())]))
    given = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", F.col("verdict").alias("set"))
    given = given.select("host", "path", key_of(F.col("host")).alias("key"), "set")
    given = given.mapInArrow(spread, "host string, path string, key string, set string, part int")
    both = placed.withColumn("set", F.lit(None).cast("string")).unionByName(given, allowMissingColumns=True)
    both = both.select("part", "key", F.col("set").isNull().alias("second"), "path", "tie", "row", "host", "set")
    both = both.repartition(n, "part").sortWithinPartitions("part", "key", "second", "path", "tie")
    schema = both.select("row", "host", "path").schema.add("rule", "string").add("verdict", "string")
    found = both.mapInArrow(sweep, schema)
    return found.select(*(F.col("row")[c].alias(c) for c in kept), *(F.col(c).alias(n) for c, n in zip(("host", "path", "rule", "verdict"), names)))
