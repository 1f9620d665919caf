"""Secret scan with multipart credential linking.

Strong patterns are reported wherever they match: a keyword with a value, a prefixed access key, a long hexadecimal
run. Weak candidates - account identifiers, key-like tokens without a keyword, endpoints - are parts of a credential
and say little alone. They are reported only where the parts that complete them lie within the same scope, an
interval of the text around the candidate: a token near an access identifier, an identifier near a secret, an
endpoint near both.

Only built-in functions run. One scan finds the matches of each pattern and keeps their lengths and the gaps between
them; positions are running sums of those, and the interval join compares a match with the last end before it and the next
start after it, so no pairs are made. Texts without a match end after the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import with_uid, written

SCOPE = 200


@dataclass(frozen=True)
class Pattern:
    """A kind of span: where it matches and what a match must have besides to count."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0
    needs: tuple[str, ...] = ()


#: In the order in which spans of one start are listed; the first three are the strong ones.
PATTERNS = (
    Pattern("assign", r"""(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            6, 1),
    Pattern("access", r"AKIA[A-Z0-9]+", 20),
    Pattern("hex", r"[0-9a-f]{24,}", 24),
    Pattern("id", r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])", 20),
    # "=" may end an assignment before a key, but neither padding nor a base64 run
    Pattern("key", r"(?<![A-Za-z0-9/+])(?<!==)(?<![A-Za-z0-9/+]{32}=)[A-Za-z0-9/+]{32,}+={0,2}+(?![A-Za-z0-9/+=])", 32,
            needs=("[a-z]", "[A-Z]", "[0-9]")),
    Pattern("endpoint", r"""https?://[A-Za-z0-9.-]+(?:[:/][^\x20\x09-\x0D"'<>]*)?""", 10),
)
STRONG = 3
IDENTIFIERS = ("access", "id")
SECRETS = ("assign", "hex", "key")


def _hits(p: Pattern, number: int, text: Column, found: Column, values: Column) -> Column:
    """Matches as (kind, i, gap, size, counts): ``gap`` characters lie between the match before and this one."""
    gaps = F.transform(F.split(text, p.regex, -1), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value"))
    def row(x, i):
        ok = F.length(x["value"]) >= p.least
        for need in p.needs:
            ok = ok & x["value"].rlike(need)
        return F.struct(F.lit(number).alias("kind"), i.alias("i"), x["gap"].alias("gap"),
                        F.length(x["hit"]).alias("size"), ok.alias("counts"))
    return F.when(F.size(found) > 0, F.transform(F.slice(rows, 1, F.size(found)), row))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, hits): the matches of every pattern, null where there are none."""
    df = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    df = df.select("*", *(F.regexp_extract_all("text", F.lit(p.regex), F.lit(0)).alias(f"found{k}")
                          for k, p in enumerate(PATTERNS)))
    hits = []
    for k, p in enumerate(PATTERNS):
        found = F.col(f"found{k}")
        values = F.regexp_extract_all("text", F.lit(p.regex), F.lit(p.group)) if p.group else found
        hits.append(_hits(p, k, F.col("text"), found, values))
    return df.select("uid", "doc_id", *(h.alias(f"hits{k}") for k, h in enumerate(hits)))


def spans(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(uid, kind, start, stop) of all reported spans, in code points; ``kind`` is the place in ``PATTERNS``."""
    each = None
    for k in range(len(PATTERNS)):
        rows = found.where(F.col(f"hits{k}").isNotNull()).select("uid", F.explode(f"hits{k}").alias("h")).select("uid", "h.*")
        each = rows if each is None else each.unionAll(rows)
    order = Window.partitionBy("uid", "kind").orderBy("i")
    stop = F.sum(F.col("gap").cast("long") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("counts")

    name = F.array(*(F.lit(p.kind) for p in PATTERNS))[F.col("kind")]
    strong = F.col("kind") < STRONG
    earlier = Window.partitionBy("uid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("uid").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def near(kinds):
        """Whether at most ``scope`` characters lie between a match and one of ``kinds`` before, after or over it."""
        own = name.isin(*kinds)
        return (F.coalesce(F.max(F.when(own, F.col("stop"))).over(earlier) >= F.col("start") - scope, F.lit(False))
                | F.coalesce(F.min(F.when(own, F.col("start"))).over(later) <= F.col("stop") + scope, F.lit(False)))

    at = at.select(
        "uid", "kind", "start", "stop",
        F.coalesce(F.max(F.when(strong, F.col("stop"))).over(earlier) > F.col("start"), F.lit(False)).alias("under"),
        F.coalesce(F.min(F.when(strong, F.col("start"))).over(later) < F.col("stop"), F.lit(False)).alias("over"),
        near(IDENTIFIERS).alias("with_id"), near(SECRETS).alias("with_secret"))
    complete = (F.when(name == "id", F.col("with_secret")).when(name == "key", F.col("with_id"))
                .otherwise(F.col("with_id") & F.col("with_secret")))
    return at.where(strong | (complete & ~F.col("under") & ~F.col("over"))).select("uid", "kind", "start", "stop")


def _listed(rows: Column) -> Column:
    names = F.array(*(F.lit(p.kind) for p in PATTERNS))
    return F.concat_ws(",", F.transform(rows, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end of every span by start, then kind, as code points with an exclusive end;
    base_sha256 is of the same list of the strong kinds only. Null text counts as empty. Repeated rows are scanned
    each; an empty table gives an empty result.
    """
    found = written(matches(docs, id_col, text_col), "matches")
    per = spans(found, scope).groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("rows"))
    rows = F.coalesce("rows", F.expr("array()").cast("array<struct<start:bigint,kind:int,stop:bigint>>"))
    df = found.select("uid", "doc_id").join(per, "uid", "left").select("doc_id", rows.alias("rows"))
    strong = F.filter("rows", lambda x: x["kind"] < STRONG)
    count = lambda k: F.size(F.filter("rows", lambda x: x["kind"] == k)).cast("long")
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                     F.sha2(_listed(strong), 256).alias("base_sha256"), _listed(F.col("rows")).alias("spans"))
