"""Contracts as ordered rule lists: the first broken rule names the row's problem (FLT20-FLT25, FLT27-FLT28, RM33-RM40, SRC02,
SRC04, SRC26-SRC27, CTL08, CTL10, UPS10, JN37, SNK07-SNK10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph

DIGEST = r"^[0-9a-f]{64}$"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
RUN_ID = r"^[a-z0-9][a-z0-9-]{7,63}$"
LANGUAGE = r"^[a-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"
OUTPUTS = ["mono", "dual"]
MIB = 1024 * 1024
SOURCE_KINDS = ["official_html", "native_xml", "pdf"]


def first_problem(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose test holds or is null; null where all are fine."""
    out = None
    for name, broken in rules:
        test = F.coalesce(broken, F.lit(True))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def matches(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern)


def page_origin_problem(url: Column, host: str = "arxiv.org") -> Column:
    """SRC02: https, the exact host, no user, no port but 443."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return first_problem([
        ("scheme", ~url.rlike("(?i)^https://")), ("user", authority.contains("@")),
        ("port", authority.rlike(r":\d+$") & ~authority.endswith(":443")),
        ("host", F.lower(F.regexp_replace(authority, r":\d+$", "")) != host),
    ])


def url_parts(url: Column) -> Column:
    """SRC02: struct(scheme, host, path, query)."""
    part = lambda p, k=1: F.regexp_extract(url, p, k)
    return F.struct(
        F.lower(part(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://")).alias("scheme"), F.lower(part(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)")).alias("host"),
        part(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)").alias("path"), part(r"\?([^#]*)").alias("query"),
    )


def source_problem() -> Column:
    """SRC26 over bytes, magic, encrypted, pages, objects, max_side."""
    return first_problem([
        ("empty", F.col("bytes") <= 0), ("too_large", F.col("bytes") > 50 * MIB), ("not_pdf", ~F.col("magic").startswith("%PDF-")),
        ("encrypted", F.col("encrypted")), ("no_pages", F.col("pages") < 1), ("too_many_pages", F.col("pages") > 500),
        ("too_many_objects", F.col("objects") > 500_000), ("page_too_large", F.col("max_side") > 14400),
    ])


def document_limit_problem(items: DataFrame, most_items: int = 50_000, most_text: int = 20_000_000, most_visuals: int = 5_000) -> DataFrame:
    """SRC27, RM24: totals a document."""
    n = items.groupBy("doc_id").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("text"), F.count_if(F.col("label").isin("picture", "table")).alias("visuals"))
    return n.withColumn("problem", first_problem([
        ("too_many_items", F.col("items") > most_items), ("too_much_text", F.coalesce("text", F.lit(0)) > most_text), ("too_many_visuals", F.col("visuals") > most_visuals),
    ]))


def budget(requests: DataFrame, by: list[str], order: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """SRC04, SRC07, CTL08: running count and bytes; once a limit is passed all later requests are refused."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = requests.withColumns({"n": F.count("*").over(w), "used": F.sum(size).over(w).cast("long")})
    return out.withColumn("allowed", (F.col("n") <= most) & (F.col("used") <= most_bytes))


def request_problem() -> Column:
    """FLT21, FLT28, RM34: a worker's request."""
    return first_problem([
        ("run_id", ~matches("run_id", RUN_ID)), ("media_type", F.col("media_type") != "application/pdf"), ("sha256", ~matches("sha256", DIGEST)),
        ("bytes", ~F.col("bytes").between(1, 50 * MIB)), ("source_language", ~matches("source_language", LANGUAGE)),
        ("target_language", ~matches("target_language", LANGUAGE)), ("same_language", F.col("source_language") == F.col("target_language")),
        ("profile_id", ~matches("profile_id", IDENTIFIER)), ("provider_id", ~matches("provider_id", IDENTIFIER)),
        ("model_id", ~matches("model_id", IDENTIFIER)), ("prompt_revision", ~matches("prompt_revision", IDENTIFIER)),
        ("glossary_sha256", F.col("glossary_sha256").isNotNull() & ~F.coalesce(matches("glossary_sha256", DIGEST), F.lit(True))),
        ("outputs", (F.size("outputs") < 1) | (F.size(F.array_except("outputs", F.array(*map(F.lit, OUTPUTS)))) > 0)),
        ("repeated_output", F.size("outputs") != F.size(F.array_distinct("outputs"))),
        ("max_pages", ~F.col("max_pages").between(1, 500)), ("max_output_bytes", ~F.col("max_output_bytes").between(1, 512 * MIB)),
        ("deadline_seconds", ~F.col("deadline_seconds").between(1, 7200)),
    ])


def profile_problem() -> Column:
    """FLT22, JN37, RM40: a provider profile joined with its request (request columns prefixed ``r_``)."""
    return first_problem([
        ("url", ~F.col("base_url").rlike(r"^https?://[^/\s@]+(?:/[^\s]*)?$")), ("key", F.coalesce(F.trim("api_key"), F.lit("")) == ""),
        ("qps", ~F.col("qps").between(1, 8)), ("profile_mismatch", F.col("profile_id") != F.col("r_profile_id")),
        ("provider_mismatch", F.col("provider_id") != F.col("r_provider_id")), ("model_mismatch", F.col("model_id") != F.col("r_model_id")),
    ])


def health_problem(required: list[str], least_version: Column, version: Column) -> Column:
    """FLT23, SET10."""
    need = F.array(*map(F.lit, required))
    return first_problem([
        ("image_digest", ~matches("image_sha256", DIGEST)), ("not_ready", ~F.col("ready")),
        ("missing_capability", F.size(F.array_except(need, "capabilities")) > 0), ("version", version < least_version),
        ("fork", ~F.col("approved_fork")),
    ])


def report_problem(report: Column, most: int = 64 * 1024, longest: int = 1000) -> Column:
    """FLT24 on JSON text: bytes, nesting of ten, string length, forbidden keys.

    The patterns for strings are possessive: they go through a string of any length without recursion.
    """
    bare = F.regexp_replace(report, r'"(?:[^"\\]++|\\.)*+"', '""')
    opened = F.regexp_replace(bare, r"[^\[\]{}]", "")
    for _ in range(10):
        opened = F.regexp_replace(opened, r"\[\]|\{\}", "")
    return first_problem([
        ("too_large", F.octet_length(report) > most), ("not_json", F.try_parse_json(report).isNull()), ("too_deep", opened != ""),
        ("long_string", report.rlike(rf'"(?:[^"\\]|\\.){{{longest + 1},}}+"')),
        ("forbidden_key", report.rlike(r'(?i)"(?:api_?key|authorization|token|password|secret|prompt|path)"\s*:')),
    ])


def active_objects(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """FLT25, RM36: action objects that can be reached from the document's root, however far; default deny."""
    starts = objects.where("is_root").select("doc_id", "object_id")
    reach = graph.reachable(starts, edges.select("doc_id", "object_id", "target_id"), "object_id", "target_id")
    return objects.join(reach, ["doc_id", "object_id"], "left_semi").where("action is not null and action not in ('GoTo','URI')")


def boundary_problem(allowed_hosts: list[str]) -> Column:
    """FLT20: a local HTTP request."""
    mutates = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    return first_problem([
        ("host", ~F.regexp_replace(F.col("host"), r":\d+$", "").isin(allowed_hosts)),
        ("cross_site", F.col("fetch_site").isNotNull() & ~F.coalesce(F.col("fetch_site").isin("same-origin", "none"), F.lit(True))),
        ("origin", mutates & F.col("origin").isNotNull() & (F.coalesce(F.col("origin"), F.lit("")) != F.concat(F.lit("http://"), "host"))),
        ("media_type", mutates & ~F.coalesce(F.col("media_type").startswith("application/json"), F.lit(False))),
    ])


def structure_problems(blocks: DataFrame, proposal: DataFrame) -> DataFrame:
    """FLT27, SET04: missing, unknown and repeated blocks, repeated orders within a page."""
    by = ["doc_id", "page"]
    p = proposal.groupBy(*by, "block_id").agg(F.count("*").alias("n"))
    both = blocks.select(*by, "block_id", F.lit(True).alias("__b")).join(p, [*by, "block_id"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__b").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    ids = both.select(*by, F.col("block_id").alias("subject"), problem.alias("problem")).where("problem is not null")
    orders = proposal.groupBy(*by, "reading_order").agg(F.count("*").alias("n")).where("n > 1")
    return ids.union(orders.select(*by, F.col("reading_order").cast("string"), F.lit("duplicate_order")))


def result_problem() -> Column:
    """RM37-RM38: an artifact joined with its staged file (``staged_`` columns) and its source (``source_bytes``)."""
    return first_problem([
        ("role", ~F.col("role").isin("mono_pdf", "dual_pdf", "report", "page_map")), ("missing_file", F.col("staged_sha256").isNull()),
        ("path", F.col("path").rlike(r"^/|(?:^|/)\.\.(?:/|$)|\\")), ("sha256", F.col("sha256") != F.col("staged_sha256")),
        ("bytes", F.col("bytes") != F.col("staged_bytes")), ("too_large", F.col("role").endswith("_pdf") & (F.col("bytes") > 5 * F.col("source_bytes"))),
    ])


def unexpected_uris(result: DataFrame, source: DataFrame) -> DataFrame:
    """SET08, RM36: addresses of a result that its source does not have."""
    return result.select("run_id", "uri").distinct().join(source.select("run_id", "uri"), ["run_id", "uri"], "left_anti")


def lock_state(now: Column, stale_after: int = 120) -> Column:
    """UPS10, RM33: idle, starting, running, stale or unknown, from owners, heartbeat and started."""
    age = F.unix_seconds(now) - F.unix_seconds("heartbeat")
    return (
        F.when(F.col("owners") == 0, "idle").when(F.col("owners") > 1, "unknown").when(F.col("heartbeat").isNull(), "unknown")
        .when(age > stale_after, "stale").when(F.col("started"), "running").otherwise("starting")
    )


def route_sources(candidates: DataFrame, kinds: list[str] | None = None, least_text: float = 0.6, most_garbled: float = 0.2) -> DataFrame:
    """CTL10: the best usable source of each paper by kind, and why the others were refused."""
    kinds = kinds or SOURCE_KINDS
    reason = (
        F.when(~F.col("available"), "unavailable").when(~F.col("access").isin("open", "local"), "access")
        .when((F.col("identity_match") != "exact") & ~((F.col("identity_match") == "equivalent") & F.col("allow_equivalent")), "identity")
        .when(F.col("validation") == "failed", "validation").when(~F.col("full_text"), "not_full_text")
        .when(F.coalesce("usable_text_ratio", F.lit(1.0)) < least_text, "little_text").when(F.coalesce("garbled_ratio", F.lit(0.0)) > most_garbled, "garbled")
    )
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    out = candidates.withColumn("rejected", reason).withColumn("__rank", F.when(rank == 0, len(kinds) + 1).otherwise(rank))
    w = W.partitionBy("paper_id", F.col("rejected").isNull()).orderBy("__rank", "candidate_id")
    place = F.when(F.col("rejected").isNull(), F.row_number().over(w))
    return out.withColumn("place", place).withColumn("chosen", F.coalesce(F.col("place") == 1, F.lit(False))).drop("__rank")


def publish(runs: DataFrame, published: DataFrame) -> DataFrame:
    """SNK07: new runs only; a run that is published already is never replaced."""
    return runs.join(published.select("run_id"), "run_id", "left_anti")


def promote(manifests: DataFrame, candidates: DataFrame) -> DataFrame:
    """SNK08-SNK09: the promoted file's path and digest, where the candidate's source digest is the manifest's."""
    c = candidates.select("job_id", F.col("source_sha256").alias("__s"), F.col("path").alias("__p"), F.col("sha256").alias("__d"))
    out = manifests.join(c, "job_id", "left")
    same = F.coalesce(F.col("__s") == F.col("source_sha256"), F.lit(False))
    return out.withColumns({
        "promoted_path": F.when(same, F.col("__p")).otherwise(F.col("promoted_path")), "promoted_sha256": F.when(same, F.col("__d")).otherwise(F.col("promoted_sha256")),
    }).drop("__s", "__p", "__d")


def verified_assets(referenced: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """SNK10, RM35: referenced assets whose stored size and digest are the manifest's."""
    m = manifest.join(referenced.select("doc_id", "asset").distinct(), ["doc_id", "asset"], "left_semi")
    return m.join(files.select("doc_id", "asset", "bytes", "sha256"), ["doc_id", "asset", "bytes", "sha256"], "left_semi")


def artifact_path_problem(path: Column, kind: Column, extensions: dict[str, list[str]]) -> Column:
    """FLT19: an artifact's path is relative, stays below its root and has an extension of its kind."""
    allowed = F.create_map(*[x for k, v in extensions.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    # what ".." steps take away must have been there before, whatever the number of steps
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")),
        lambda a, s: F.struct(
            (a["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(a["least"], a["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("least"),
        ),
    )
    return first_problem([
        ("empty", F.coalesce(path, F.lit("")) == ""), ("absolute", path.rlike(r"^(?:[/\\]|[A-Za-z][A-Za-z0-9+.-]*:)")),
        ("character", path.rlike(r"[\x00-\x1F\\]")), ("outside", depth["least"] < 0),
        ("extension", ~F.coalesce(F.array_contains(F.try_element_at(allowed, kind), extension), F.lit(False))),
    ])


def candidate_request(run_id: Column, source: Column, glossary_sha256: Column, outputs: list[str], max_pages: int, deadline_seconds: int) -> Column:
    """RM39: the request of a candidate run; ``source`` has sha256, bytes, source_language and target_language."""
    return F.struct(
        run_id.alias("run_id"), *[source[c].alias(c) for c in ("sha256", "bytes", "source_language", "target_language")],
        glossary_sha256.alias("glossary_sha256"), F.array(*map(F.lit, outputs)).alias("outputs"), F.lit(max_pages).alias("max_pages"),
        F.lit(deadline_seconds).alias("deadline_seconds"),
    )


def provenance_mismatches(request: Column, result: Column, fields: list[str]) -> Column:
    """RM39: names of the fields in which a result differs from its request; a missing value differs."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(request[f] == result[f], F.lit(False)), f) for f in fields]))
