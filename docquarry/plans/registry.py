"""All registered queries and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.functions.dialect import DUCK, SPARK
from docquarry.operators import latent
from docquarry.plans import answers, attached, catalog, derived, encoding, fixtures, mixed, scopes, upkeep
from docquarry.plans.relations import duck_sql, kept

BUILDERS = catalog.QUERIES | answers.QUERIES | upkeep.QUERIES | upkeep.DELETED | encoding.PLAIN
OVER_BLOCKS = mixed.QUERIES | fixtures.QUERIES | encoding.OVER_BLOCKS | {"attachments": lambda d: "SELECT doc_id, aux FROM @attachments@"}

#: Over trained vectors (operators.latent), which SQL can't restate.
LATENT = {f"latent_{name}": catalog.QUERIES[name] for name in "knn_top50 z_score retrieve_hybrid evidence_gate best_sentences decision_route".split()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of every question of the batch."""
    return queries()["retrieve_hybrid"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    over_documents = {name: lambda spark, sf_dir, b=build: kept(spark, sf_dir).statement(b(SPARK)) for name, build in BUILDERS.items()}
    over_blocks = {name: lambda spark, sf_dir, b=build: kept(spark, sf_dir, "mixed", derived.MIXED).statement(b(SPARK)) for name, build in OVER_BLOCKS.items()}
    over_scopes = {name: lambda spark, sf_dir, b=build: kept(spark, sf_dir, "scoped", scopes.SCOPED).statement(b(SPARK)) for name, build in scopes.QUERIES.items()}
    over_talk = {name: lambda spark, sf_dir, b=build: kept(spark, sf_dir, "attached", attached.ATTACHED).statement(b(SPARK)) for name, build in attached.QUERIES.items()}
    over_trained = {name: lambda spark, sf_dir, b=build: kept(spark, sf_dir, "latent", fit=latent.fit).statement(b(SPARK)) for name, build in LATENT.items()}
    over_parsed = {name: lambda spark, sf_dir, b=build: encoding.corpus(spark, sf_dir).statement(b(SPARK)) for name, build in encoding.PARSED.items()}
    return over_documents | over_blocks | over_scopes | over_talk | over_trained | over_parsed


def oracle_sql() -> dict[str, str]:
    found = {name: duck_sql(build(DUCK)) for name, build in BUILDERS.items()}
    for over, changed in ((upkeep.DELETED, upkeep.REBUILT), (OVER_BLOCKS, derived.MIXED), (scopes.QUERIES, scopes.SCOPED), (attached.QUERIES, attached.ATTACHED)):
        found |= {name: duck_sql(build(DUCK), changed) for name, build in over.items()}
    return found
