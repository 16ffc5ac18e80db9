"""Secret scan with corpus-wide ownership frequency.

Candidates are found by regular expressions, hashed, and counted over the whole
corpus by distinct repositories and distinct owners. A value that more than
OWNERS_OF_EXAMPLE owners or more than REPOS_OF_EXAMPLE repositories carry is a
widely copied example; one that stays within fewer of both and has enough
distinct characters looks live. Base spans are always reported; the method adds
spans of kind `opaque` (long mixed-case strings with digits) where the
frequency shows that they are live.

Regular expressions give no positions, so spans come from the gaps: splitting a
text at the matches gives the pieces between them, and running lengths of pieces
and matches give each match's start, in code points. Tables hold hashes of the
values, never the values.

Defined cases: a null text counts as empty and has no spans; the digest of no
spans is that of the empty string; null owners and repositories count as one
value of their own, so rows without an identifier are one repository; rows that
repeat an identifier are separate rows, told apart by a row number of the
materialised table; a value that repeats in one document counts once for its
repository; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Kinds in their order, with pattern, group that holds the value, and least length of it.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9+/_-]{32,}", 0, 32),
]
BASE = ["assign", "access", "hex"]
#: More distinct owners or repositories than this make a value a copied example.
OWNERS_OF_EXAMPLE, REPOS_OF_EXAMPLE = 2, 20
#: Fewer distinct characters than this make a value a placeholder.
LEAST_DISTINCT = 8


FOUND = "array<struct<rank:int,at:int,gap:int,length:int,kept:boolean,value_hash:string,n_chars:int>>"


def matches(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of all matches in order: rank, place among the kind's, gap before it, length, whether it is long enough, hash and distinct characters of its value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    zipped = F.zip_with(whole, F.slice(gaps, 1, F.size(whole)), lambda m, g: F.struct(m.alias("m"), g.alias("g"), (F.regexp_extract(m, pattern, group) if group else m).alias("value")))

    def one(x: Column, at: Column) -> Column:
        value = x["value"]
        kept = F.char_length(value) >= least
        if rank == len(KINDS) - 1:
            kept &= value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        return F.struct(F.lit(rank).alias("rank"), at.alias("at"), x["g"].alias("gap"), F.char_length(x["m"]).alias("length"), kept.alias("kept"), F.sha2(value, 256).alias("value_hash"), F.size(F.array_distinct(F.split(value, ""))).alias("n_chars"))

    return F.when(text.rlike(pattern), F.transform(zipped, one)).otherwise(F.array().cast(FOUND))


def find_candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per row of docs, without its text: row, doc_id, repo, owner, found (all matches by kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = [matches(text, rank, pattern, group, least) for rank, (_, pattern, group, least) in enumerate(KINDS)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.concat(*parts).alias("found"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")


def spans_of(rows: DataFrame) -> DataFrame:
    """row, repo, owner, start, rank, end, value_hash, n_chars of the matches that are long enough; starts are running sums of gaps and lengths."""
    each = rows.select("row", "repo", "owner", F.explode("found").alias("m")).select("row", "repo", "owner", "m.*")
    upto = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = each.withColumn("end", upto.cast("int")).filter("kept")
    return placed.select("row", "repo", "owner", (F.col("end") - F.col("length")).alias("start"), "rank", "end", "value_hash", "n_chars")


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners over the whole corpus; candidates has value_hash, repo, owner.

    Two steps of distinct pairs, each combined before its shuffle, so that a
    value on a third of all rows costs one row per task, repository and owner.
    """
    repos = candidates.groupBy("value_hash", "repo").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = candidates.groupBy("value_hash", "owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "value_hash")


def verdict() -> Column:
    """copied, placeholder or live, from n_owners, n_repos and the value's distinct characters."""
    return F.when((F.col("n_owners") > OWNERS_OF_EXAMPLE) | (F.col("n_repos") > REPOS_OF_EXAMPLE), "copied").when(F.col("n_chars") < LEAST_DISTINCT, "placeholder").otherwise("live")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, secrets (start, end, kind, value_hash, n_repos, n_owners, verdict by start, then kind)."""
    rows = find_candidates(docs, id_col, text_col, repo_col, owner_col)
    spans = materialize(spans_of(rows), "spans")
    stats = ownership(spans)
    judged = spans.join(stats, "value_hash").withColumn("verdict", verdict())
    kept = judged.filter((F.col("rank") < len(BASE)) | (F.col("verdict") == "live"))
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("rank") + 1)
    one = F.struct("start", "rank", "end", kind.alias("kind"), "value_hash", "n_repos", "n_owners", "verdict")
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("secrets"))
    return rows.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("secrets", F.array().cast(per_row.schema["secrets"].dataType)).alias("secrets"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans, n_copied, n_live of scan_secrets()."""
    join = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    of_kind = lambda k: lambda s: s["kind"] == k
    count = lambda test: F.size(F.filter("secrets", test)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(join(base), 256).alias("base_sha256"),
        join(F.col("secrets")).alias("spans"),
        count(lambda s: s["verdict"] == "copied").alias("n_copied"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
    )
