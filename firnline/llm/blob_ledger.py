"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its bytes (its blob). The ledger is a
Parquet table of (blob, rules scanned with their versions, spans found). A scan

  1. lists the blobs of all paths (rows) and keeps those with a (blob, rule version) pair that the
     ledger lacks,
  2. runs just the missing rules over one copy of each such blob and appends the result,
  3. joins the findings of the wanted rule versions back to all paths of each blob.

A changed rule gets a new version and is scanned over old blobs alone; unchanged ones are not
repeated. Appends become visible when their job commits, and a pair that two runs have scanned
counts once, so a lost run is simply repeated. Copies are combined before the shuffle, and findings
meet their paths in a join that Spark can split for a blob with very many paths.

Spans count code points, their end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.texts import let
from firnline.session import shared_folder, stored

SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern that do not overlap; dropped if group has fewer than least characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds first, in the order in which kinds are listed; then further ones.
RULES = (
    Rule("assign", ASSIGN, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # whole runs either way: shorter ones are never wanted
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
BASE = 3
#: Code points in a chunk of a text that is cut at spans.
CHUNK = 1024


def running(values: Column, combine) -> Column:
    """Running combination of the numbers in an array, by doubling: n log n steps for n values, and no array grows value by value."""
    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    turns = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    earlier = lambda a, i, k: F.get(a, i - F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(turns, values, lambda a, k: F.transform(a, lambda x, i: F.when(earlier(a, i, k).isNull(), x).otherwise(combine(x, earlier(a, i, k)))))


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of one rule: running lengths of the pieces between matches and the matches themselves give the positions."""
    def placed(x: Column) -> Column:
        lengths = F.transform(x["matches"], lambda m, i: F.length(F.get(x["pieces"], i)) + F.length(m))
        good = lambda m: F.length(m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least
        spans = let(running(lengths, lambda u, v: u + v), lambda ends: F.transform(x["matches"], lambda m, i: F.when(good(m), F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end")))))
        return F.filter(spans, lambda s: s.isNotNull())

    both = F.struct(F.split(text, rule.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(rule.pattern), 0).alias("matches"))
    return F.when(text.rlike(rule.pattern), let(both, placed)).otherwise(F.array().cast(SPAN))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing has been written yet
        return None


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at path up to date for the texts of docs; returns (blob, spans) of blobs with findings.

    spans are sorted by start, then by the place of their rule in rules.
    """
    spark = docs.sparkSession
    every = F.array(*[F.lit(r.key) for r in rules])
    texts = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    old = _ledger(spark, path)
    if old is None:
        texts = texts.withColumn("todo", every)
    else:
        seen = old.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        texts = texts.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))) \
            .where(F.size("todo") > 0).drop("seen")
    once = texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    none = F.array().cast(SPAN)
    found = [F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    keys = F.lit([r.key for r in rules])
    named = F.transform(F.flatten(F.array(*found)), lambda s: F.struct(F.get(keys, s["kind"]).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    once.select("blob", F.col("todo").alias("rules"), named.alias("spans")).write.mode("append").parquet(path)
    spans = spark.read.parquet(path).where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    kind = F.coalesce(*[F.when(F.col("s.rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    spans = spans.select("blob", F.struct(F.col("s.start").alias("start"), kind.alias("kind"), F.col("s.end").alias("end")).alias("s")).where("s.kind is not null")
    return stored(spans.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans")), "secret-findings")


def labelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.lit([r.name for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and its spans for every row of docs (an empty array without findings).

    path is the ledger; a new one is begun if it is None. NULL texts count as empty; repeated rows
    stay, each with the findings of its blob; other columns are ignored.
    """
    path = path or shared_folder(docs.sparkSession, "secret-ledger")
    found = scan(docs, path, rules)
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_more."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return findings(docs, path).select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(labelled(base), 256).alias("base_sha256"), labelled(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] >= BASE)).cast("long").alias("n_more"))


def cut(chunks: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end (exclusive) of a text that is split in chunks of CHUNK code points."""
    first, last = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    whole = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    part = lambda j: F.coalesce(F.get(chunks, j), F.lit(""))
    return F.when(first == last, F.substring(part(first), begin % CHUNK + 1, end - begin)).otherwise(
        F.concat(F.substring(part(first), begin % CHUNK + 1, F.lit(CHUNK)), whole, F.substring(part(last), F.lit(1), end % CHUNK)))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of its spans (sorted by start), overlapping ones as one; time grows with text and spans."""
    def body(x: Column) -> Column:
        before = lambda i: F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
        parts = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(x["chunks"], before(i), s["start"]), F.lit(mark))))
        rest = cut(x["chunks"], F.element_at(x["reach"], -1), F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0).alias("chunks"), spans.alias("spans"), reach.alias("reach")), body)


def redacted(docs: DataFrame, path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by mark, and n_chars (if there) counted anew."""
    found = scan(docs, path or shared_folder(docs.sparkSession, "secret-ledger"))
    rows = docs.select(F.struct("*").alias("doc"), blob_of(F.col("text")).alias("blob")).join(found, "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col("doc.text")).otherwise(replaced(F.col("doc.text"), F.col("spans"), mark))
    rows = rows.select("doc", clean.alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNull(), F.col("doc")["n_chars"] if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("clean").cast("long"))}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("doc")[c].alias(c) for c in docs.columns])


def oracle(table: str = "documents", inner: bool = False) -> str:
    """counts() in DuckDB SQL: positions from the pieces that are left when matches are marked."""
    escape = lambda p: p.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        p = escape(r.pattern)
        good = f"length(regexp_extract(m[j], '{p}', {r.group})) >= {r.least}"
        parts.append(f"""
f{i} AS (SELECT rid, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda j:
    {{'s': list_sum(list_transform(p[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0), 'k': {i}, 'n': length(m[j]), 'ok': {good}}}),
    lambda z: z.ok)) AS z FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM texts))""")
    names = "[" + ", ".join(f"'{r.name}'" for r in RULES) + "]"
    tail = "" if inner else f"""
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_more, 0)::BIGINT AS n_more FROM texts LEFT JOIN found USING (rid)"""
    return f"""WITH texts AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {table}),{','.join(parts)},
allspans AS ({' UNION ALL '.join(f'SELECT rid, z.s AS s, z.k AS k, z.s + z.n AS e FROM f{i}' for i in range(len(RULES)))}),
found AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_more,
  string_agg({names}[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < {BASE}) AS base,
  string_agg({names}[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans FROM allspans GROUP BY rid){tail}"""
