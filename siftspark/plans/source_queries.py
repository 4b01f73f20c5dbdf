"""Registered queries over the syntax of sources made from the given tables, with their SQL twins."""

from __future__ import annotations

from siftspark.operators import concurrency, inverses, scopes, seams, values, verification
from siftspark.plans import adapters as a
from siftspark.plans import project_sources, seam_sources, value_sources
from siftspark.plans.queries import emitted, query
from siftspark.session import stored_wide
from siftspark.sources import documents, inventory, syntax


@query(project_sources.uses_sql())
def name_uses(spark, d):
    nodes = stored_wide(syntax.nodes(project_sources.sources(a.table(spark, d, "supplier"))), "nodes").where("path LIKE 'src/%'")
    return scopes.resolved(nodes).select("path", "line", "name", "defined", "how", "origin")


@query(project_sources.GAPS_SQL)
def verification_gaps(spark, d):
    sources = project_sources.sources(a.table(spark, d, "supplier"))
    return verification.gaps(sources, stored_wide(syntax.nodes(sources), "nodes"))


@query(project_sources.FAULTS_SQL)
def fault_boundaries(spark, d):
    sources = project_sources.sources(a.table(spark, d, "supplier"))
    return verification.fault_boundaries(sources, stored_wide(syntax.nodes(sources), "nodes"))


emitted("BHFAULT001", "fault_boundaries")


@query(value_sources.findings_sql())
def value_contradictions(spark, d):
    return values.contradictions(syntax.nodes(value_sources.sources(a.table(spark, d, "part")))).drop("message")


@query(project_sources.THREADS_SQL)
def unsynchronized_writers(spark, d):
    return concurrency.unsynchronized(stored_wide(syntax.nodes(project_sources.threads(a.table(spark, d, "supplier"))), "nodes"))


emitted("BHCONC001", "unsynchronized_writers")


def _seams(spark, d):
    return stored_wide(syntax.nodes(seam_sources.sources(a.table(spark, d, "supplier"))), "nodes")


@query(seam_sources.FORWARDING_SQL)
def rejected_keywords(spark, d):
    return seams.rejected_keywords(_seams(spark, d))


@query(seam_sources.SHAPES_SQL)
def unmet_keys(spark, d):
    return seams.unmet_keys(_seams(spark, d))


@query(seam_sources.MODELS_SQL)
def drifted_models(spark, d):
    return seams.drifted_models(_seams(spark, d), documents.schemas(seam_sources.schema_files(a.table(spark, d, "supplier"))))


@query(seam_sources.DOMAINS_SQL)
def inconsistent_rejections(spark, d):
    return seams.inconsistent_rejections(_seams(spark, d))


@query(seam_sources.TRIPS_SQL)
def round_trips(spark, d):
    return inverses.round_trips(stored_wide(syntax.nodes(seam_sources.trips(a.table(spark, d, "supplier"))), "nodes"))


@query("""WITH f AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/.git' WHEN 1 THEN 'src/lib/node_modules/m' WHEN 2 THEN 'src/git' ELSE 'docs' END || '/f' || p_partkey || CASE WHEN p_size % 3 = 0 THEN '.txt' ELSE '.py' END AS path, p_size AS size FROM part)
SELECT path, CAST(size AS BIGINT) AS size FROM f WHERE path LIKE 'src/git/%.py'""")
def pruned_walk(spark, d):
    """Files below a root, without those in folders that a walk doesn't enter; a folder whose name only ends like one stays."""
    folder = "CASE p_partkey % 4 WHEN 0 THEN 'src/.git' WHEN 1 THEN './src/lib/node_modules/m' WHEN 2 THEN 'src//git' ELSE 'docs' END"
    files = a.table(spark, d, "part").selectExpr(f"concat({folder}, '/f', p_partkey, if(p_size % 3 = 0, '.txt', '.py')) AS path", "CAST(p_size AS BIGINT) AS size", "CAST(NULL AS STRING) AS head")
    return inventory.in_scope(files, ["src"], (".py",), (".git", "node_modules")).select("path", "size")
