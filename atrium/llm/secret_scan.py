"""Secret scans over a ledger of blobs, in DataFrame functions only.

Every historical version of a text is addressed by the SHA-256 of its bytes. A ledger holds, for each
blob and each version of a rule, the spans found. A run scans only the (blob, rule version) pairs that
the ledger lacks, each distinct blob once however many paths hold it, and joins findings to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrium.llm.tables import table, unused
from atrium.storage import new_path, stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` as Java regex; a match counts if its group ``group`` has ``least`` characters or more.

    ``hints``: lower-case strings of which the lower-cased text must hold one for any match; without any, the pattern
    itself is tried.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


#: The order is the order of kinds at equal starts.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", hints=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("-----begin",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
)
#: A private key from BEGIN to END; where END is missing, to the last line of base64. Breaks may be written as \\n.
_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}[^-]++){0,200}+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info): [^\r\n]*+){0,2}+(?:(?:\s|\\[nr])++[A-Za-z0-9+/]{16,}+={0,2}+){1,1000}+"
    r"(?:(?:\s|\\[nr])++[A-Za-z0-9+/]++={0,2}+(?=[ \t]*(?:[\r\n\\]|$)))?+)?+"
)
#: For overwriting: the whole key, of which the rule ``pem`` and its SQL report the first line.
WHOLE = tuple(replace(r, version=2, pattern=_KEY) if r.kind == "pem" else r for r in RULES)
BASE_KINDS = ("assign", "access", "hex")
LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _hinted(text: Column, rule: Rule) -> Column:
    """Whether ``text`` can hold a match of the rule at all."""
    if not rule.hints:
        return text.rlike(rule.pattern)
    low = F.lower(text)
    hit = low.contains(rule.hints[0])
    for hint in rule.hints[1:]:
        hit = hit | low.contains(hint)
    return hit


def may_hold(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule can match; false for null. Most texts can be cleared by this where they stand."""
    out = F.lit(False)
    for rule in rules:
        out = out | _hinted(text, rule)
    return F.coalesce(out, F.lit(False))


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches in ``text`` in order: what stands before each, its length, and whether it counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    found = F.transform(
        F.filter(zipped, lambda x: x["whole"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(order).alias("kind_no"), i.alias("i"), F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("length"), (F.length(x["value"]) >= rule.least).alias("counts"),
        ),
    )
    none = F.array().cast("array<struct<kind_no:int,i:int,gap:int,length:int,counts:boolean>>")
    return F.when(F.array_contains("todo", order) & _hinted(text, rule), found).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for ``blobs(blob, text, todo)``, one for each blob and rule number in ``todo``.

    Positions are sums of what came before, taken over the blob's matches of one rule, so a text with very
    many matches costs in proportion to them. Starts and ends count code points.
    """
    found = F.concat(*[_matches(F.col("text"), r, i) for i, r in enumerate(rules)])
    rows = blobs.select("blob", "todo", F.explode_outer(found).alias("m")).select("blob", "todo", "m.*")
    before = Window.partitionBy("blob", "kind_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("gap").cast("long") + F.col("length")).over(before)
    placed = rows.withColumn("end", upto).withColumn("start", upto - F.col("length"))
    span = F.when(F.col("counts"), F.struct("kind_no", "start", "end"))
    per_blob = placed.groupBy("blob").agg(F.first("todo").alias("todo"), F.collect_list(span).alias("all"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    versions = F.array(*[F.lit(r.version) for r in rules])
    done = per_blob.select("blob", "all", F.explode("todo").alias("k"))
    own = F.transform(
        F.array_sort(F.filter("all", lambda x: x["kind_no"] == F.col("k"))),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")),
    )
    return done.select(
        "blob", F.get(names, F.col("k")).alias("kind"), F.get(versions, F.col("k")).alias("version"), own.alias("spans")
    )


def _todo(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``blobs`` with ``todo``, the numbers of the rules they were not scanned with; those with none left out."""
    every = F.array(*[F.lit(i) for i in range(len(rules))])
    if ledger is None:
        return blobs.withColumn("todo", every)
    done = ledger.select("blob", _number(rules).alias("k")).where("k IS NOT NULL")
    done = done.groupBy("blob").agg(F.collect_set("k").alias("done"))
    todo = F.array_except(every, F.coalesce("done", F.array().cast("array<int>")))
    return blobs.join(done, "blob", "left").select(*blobs.columns, todo.alias("todo")).where(F.size("todo") > 0)


def _number(rules: tuple[Rule, ...]) -> Column:
    """The number of a ledger row's rule; null for other rules and versions."""
    return F.coalesce(
        *[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)]
    )


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, text, todo)``: each distinct blob that can hold a secret, once, with the rules still to be run on it.

    Only these texts are shuffled; copies meet within a task first, so a hot group is a row a task.
    """
    held = versions.where(may_hold(F.col("text"), rules))
    return _todo(held.select(blob_id(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"]), ledger, rules)


def cleared(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows without spans for the unseen blobs that can't hold a secret."""
    free = versions.where(~may_hold(F.col("text"), rules)).select(blob_id(F.col("text")).alias("blob")).distinct()
    rows = _todo(free, ledger, rules).select("blob", F.explode("todo").alias("k"))
    names, numbers = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.version) for r in rules])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.select("blob", F.get(names, F.col("k")).alias("kind"), F.get(numbers, F.col("k")).alias("version"), none.alias("spans"))


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """Scan ``versions(doc_id, text, ...)`` and return ``(findings, new)``.

    ``findings``: a row for each row of ``versions`` with doc_id, blob and ``spans``, an array of
    (start, kind_no, kind, end) ordered by start and then kind; empty where nothing was found. Null texts
    are the empty blob; rows with a null doc_id and repeated rows keep a row each; other columns are left
    behind. ``new``: the ledger rows of this run, for the pairs of blob and rule version that ``ledger`` lacks.
    """
    versions = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    new = stored(scan_blobs(unseen(versions, ledger, rules), rules).unionByName(cleared(versions, ledger, rules)))
    full = new if ledger is None else ledger.unionByName(new)
    spans = full.withColumn("kind_no", _number(rules)).where("kind_no IS NOT NULL AND size(spans) > 0")
    spans = spans.select("blob", "kind", "kind_no", F.explode("spans").alias("s")).groupBy("blob")
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("s.start", "kind_no", "kind", "s.end"))).alias("spans"))
    paths = versions.select("doc_id", blob_id(F.col("text")).alias("blob"))
    findings = paths.join(stored(spans), "blob", "left")
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>")
    return findings.select("doc_id", "blob", F.coalesce("spans", none).alias("spans")), new


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def scan_incrementally(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, first: bool = False) -> DataFrame:
    """Findings for ``versions``, scanning only what the ledger at ``path`` lacks, and adding that to it.

    ``first`` begins a ledger there. What is scanned twice is never written twice: a run that is repeated after a failure
    finds the pairs of the one before.
    """
    ledger = None if first else read_ledger(versions.sparkSession, path)
    findings, new = scan(versions, ledger, rules)
    new.write.mode("append").parquet(path)
    return findings


def written(spans: Column) -> Column:
    """``kind:start:end`` in order, comma-joined; empty for none."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger: the base rules, then all rules, which scans no blob again with those before."""
    docs, path = table(spark, sf_dir, "documents"), f"{new_path(spark)}/ledger"
    scan_incrementally(docs, path, tuple(r for r in RULES if r.kind in BASE_KINDS), first=True)
    findings = scan_incrementally(docs, path)
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = F.sha2(written(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256")
    return findings.select("doc_id", *counts, base, written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", rules: tuple[Rule, ...] = WHOLE) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced once. Private keys go whole.

    All rows and columns stay; texts without findings are untouched and, where no rule can match, not shuffled; ``n_chars``, where there is one, follows
    the new text. Findings come by content, not by doc_id, so repeated and null ids are no trouble.
    """
    spans = stored(_found(docs, rules))
    [key, found], suspect = unused(docs, "blob", 2), may_hold(F.col("text"), rules)
    held = docs.where(suspect).withColumn(key, blob_id(F.col("text")))
    joined = held.join(spans.select(F.col("blob").alias(key), F.col("spans").alias(found)), key, "left")
    text = F.col("text")
    at = F.expr("CAST(0 AS BIGINT)")
    step = lambda acc, s: F.when(
        s["end"] <= acc["at"], acc
    ).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"],
                F.when(
                    s["start"] >= acc["at"],
                    F.concat(F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)),
                ).otherwise(F.lit("")),
            ).alias("out"),
        )
    )
    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    start = F.struct(at.alias("at"), F.lit("").alias("out"))
    clean = F.when(F.col(found).isNull(), text).otherwise(F.aggregate(found, start, step, end))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        size = F.when(F.col(found).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))
    return docs.where(~suspect).unionByName(out.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _found(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, spans)`` of the blobs with findings."""
    versions = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ledger = stored(scan_blobs(unseen(versions, None, rules), rules))
    rows = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    return rows.groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("spans"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pats AS (SELECT * FROM (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', '(AKIA[A-Z0-9]{16,})'),
  (2, 'hex', '([0-9a-f]{24,})'),
  (3, 'pem', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)'),
  (4, 'jwt', '(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})')) v(kind_no, kind, p)),
m AS (SELECT doc_id, kind_no, kind, regexp_extract_all(t, p, 0) AS w, regexp_extract_all(t, p, 1) AS v,
        string_split_regex(t, p) AS g FROM d, pats),
e AS (SELECT doc_id, kind_no, kind, unnest(range(1, len(w) + 1)) AS i, w, v, g FROM m),
s AS (SELECT doc_id, kind_no, kind, length(v[i]) AS n,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS b,
        length(w[i]) AS l FROM e),
f AS (SELECT doc_id, kind_no, kind, CAST(b AS BIGINT) AS b, CAST(b + l AS BIGINT) AS z FROM s WHERE kind_no <> 0 OR n >= 6),
a AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
        count(*) FILTER (kind_no = 2) AS n_hex,
        string_agg(kind || ':' || b || ':' || z, ',' ORDER BY b, kind_no) FILTER (kind_no < 3) AS base,
        string_agg(kind || ':' || b || ':' || z, ',' ORDER BY b, kind_no) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
