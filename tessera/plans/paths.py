"""What a retrieval plan is made of, as arrays of structs: paths, stages, fallback and operators for each query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASSET_ROUTES = ("asset_first", "text_plus_asset")
# Names of a plan's operators, in order.
OPENING = ("VersionGate", "EntitlementFilter", "QueryRewrite", "PredicatePushdown", "SectionSearch")
CLOSING = ("HybridFusion", "PreRerankCleanup", "Rerank", "ConfidenceAudit")


def _kept(*items: tuple[Column, Column]) -> Column:
    """The structs whose condition holds, in order."""
    marked = F.array(*(F.struct(ok.alias("ok"), item.alias("item")) for ok, item in items))
    return F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["item"])


def wants_assets(needs_special: Column, route: Column) -> Column:
    return needs_special | route.isin(*ASSET_ROUTES)


def _path(branch: str, limit: Column, variant: str) -> Column:
    return F.struct(F.lit(branch).alias("branch"), limit.cast("int").alias("limit"), F.lit(variant).alias("variant"))


def retrieval_paths(profile: Column, limit: Column, needs_structure: Column, needs_metadata: Column, needs_special: Column, route: Column, summaries: bool) -> Column:
    """Branches of a query with their limits and variants.

    With summary indexes: vectors, twice the limit but for the fast profile, and assets where they
    are wanted. Without: fast is vectors alone; the asset profile doubles the assets; deep and the
    others add local and global search, and all but fast the sparse branches that the query needs.
    """
    fast, asset, deep = (profile == p for p in ("fast", "asset", "deep"))
    special = wants_assets(needs_special, route)
    if summaries:
        return _kept((F.lit(True), _path("vector", F.when(fast, limit).otherwise(limit * 2), "dense")), (asset | special, _path("special", limit, "dense")))
    graph = F.when(deep, limit).otherwise(F.greatest(F.lit(2), limit - 1))
    return _kept(
        (~fast & ~asset, _path("local", graph, "dense")), (~fast & ~asset, _path("global", graph, "dense")),
        (F.lit(True), _path("vector", F.when(fast, limit * 2).otherwise(limit), "dense")), (asset, _path("special", limit * 2, "dense")),
        (~fast & needs_structure, _path("section", limit, "sparse")), (~fast & needs_metadata, _path("metadata", limit, "sparse")), (~fast & ~asset & special, _path("special", limit, "dense")),
    )


def _stage(branch: str, collection: str, limit: Column, least: Column, trigger: str) -> Column:
    return F.struct(F.lit(branch).alias("branch"), F.lit(collection).alias("collection"), limit.cast("int").alias("limit"), least.cast("int").alias("min_hits"), F.lit(trigger).alias("trigger"))


def stage_plans(limit: Column, final_limit: Column, needs_special: Column, route: Column) -> Column:
    """Stages over the summary indexes: sections, then documents if these are too few, and assets where they are wanted."""
    floor = F.greatest(F.lit(2), F.least(final_limit, F.lit(5)))
    return _kept(
        (F.lit(True), _stage("vector", "section_summary", limit * 2, floor, "always")), (F.lit(True), _stage("vector", "doc_summary", F.greatest(limit, floor), floor, "if_insufficient")),
        (wants_assets(needs_special, route), _stage("special", "asset_summary", limit, F.greatest(F.lit(1), F.least(final_limit, F.lit(3))), "always")),
    )


def fallback_plan(limit: Column, needs_special: Column, route: Column, enabled: Column) -> Column:
    """The branches to run again, and on which signal."""
    step = F.struct(F.lit("asset_fallback").alias("trigger"), F.lit("special").alias("branch"), F.lit("asset_summary").alias("collection"), limit.cast("int").alias("limit"))
    return _kept((enabled & wants_assets(needs_special, route), step))


def operator_plan(gate: Column, needs_special: Column, route: Column) -> Column:
    """Names of the operators that a query goes through."""
    yes, complex_ = F.lit(True), gate == "complex"
    return _kept(
        *((yes, F.lit(x)) for x in OPENING), (complex_, F.lit("QueryDecomposition")), (complex_, F.lit("DocFallback")), (wants_assets(needs_special, route), F.lit("AssetSearch")), *((yes, F.lit(x)) for x in CLOSING),
    )


def selected_branches(paths: Column, fallback: Column, signal: Column, web_allowed: Column) -> Column:
    """Branches to run: those of the paths, those that the signal's fallback steps add, and web where it is allowed; each once."""
    own = F.transform(paths, lambda p: p["branch"])
    again = F.transform(F.filter(fallback, lambda s: s["trigger"] == signal), lambda s: s["branch"])
    return F.array_distinct(F.concat(own, again, F.when(web_allowed, F.array(F.lit("web"))).otherwise(F.array().cast("array<string>"))))


def collection_clauses(base: str = "", source_types: tuple[str, ...] = (), pages: tuple[int, ...] = (), page_ranges: tuple[tuple[int, int], ...] = (), assets: tuple[str, ...] = ()) -> dict[str, str]:
    """Filter expressions by collection, in the syntax that `expressions.parse` reads; the base goes with each."""
    listed = lambda values: ", ".join(f'"{v}"' if isinstance(v, str) else str(v) for v in dict.fromkeys(values))
    out: dict[str, list[str]] = {}

    def add(clause: str, *collections: str) -> None:
        for c in collections:
            out.setdefault(c, []).append(clause)

    if source_types:
        add(f"source_type in [{listed(source_types)}]", "doc_summary", "section_summary")
    if pages:
        own = sorted(set(pages))
        add(" or ".join(f"(page_start <= {p} and page_end >= {p})" for p in own), "section_summary")
        add(f"page_no in [{listed(own)}]", "asset_summary")
    if page_ranges:
        add(" or ".join(f"(page_start <= {b} and page_end >= {a})" for a, b in page_ranges), "section_summary")
        add(" or ".join(f"(page_no >= {a} and page_no <= {b})" for a, b in page_ranges), "asset_summary")
    if assets:
        add(f"asset_type in [{listed(assets)}]", "asset_summary")
    joined = {c: " and ".join(f"({x})" if len(parts) > 1 else x for x in parts) for c, parts in out.items()}
    if not base:
        return joined
    return {c: f"({base}) and ({joined[c]})" if c in joined else base for c in ("doc_summary", "section_summary", "asset_summary")}
