"""The questions users ask of one data folder, as functions that return DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import text as tx
from clausewright.operators import graph, labels, links, repair, search
from clausewright.sources.tables import table


class Regulations:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.clause_nodes(self._table("clauses"))

    @cached_property
    def ancestors(self) -> DataFrame:
        return graph.ancestors(self.nodes)

    @cached_property
    def references(self) -> DataFrame:
        return graph.reference_edges(self._table("clauses"), self.nodes)

    @cached_property
    def labels(self) -> DataFrame:
        return labels.node_labels(self.nodes, labels.requirement_labels(self._table("requirements")))

    @cached_property
    def index(self) -> DataFrame:
        return repair.clause_index(self._table("clauses"), self.labels, self.ancestors)

    def search_clauses(self, doc: str, query: str, k: int = 12, testable_only: bool = False) -> DataFrame:
        """Candidates with role, breadcrumb and preview, best first."""
        index = self.index.filter(F.col("reg_doc") == doc)
        if testable_only:
            index = index.filter("testable")
        asked = self.spark.createDataFrame([("q", doc, query)], "query_id string, reg_doc string, query string")
        found = search.top_matches(asked, index, k).join(index, ["reg_doc", "node"]).join(search.breadcrumbs(self.ancestors, self.index), ["reg_doc", "node"], "left")
        return found.select("rank", "node", "title", search.role(F.col("category"), F.col("force")).alias("role"), "breadcrumb", "text_preview").orderBy("rank")

    def get_clause(self, doc: str, node: str) -> DataFrame:
        """Text, labels, parent, children and references of one clause."""
        one = self.index.filter((F.col("reg_doc") == doc) & (F.col("node") == node))
        kids = graph.contains_edges(self.ancestors).filter((F.col("reg_doc") == doc) & (F.col("src") == node)).agg(F.array_sort(F.collect_list("dst")).alias("children"))
        out = self.references.filter((F.col("reg_doc") == doc) & (F.col("src") == node)).agg(F.array_sort(F.collect_list("dst")).alias("refers_to"))
        into = self.references.filter((F.col("reg_doc") == doc) & (F.col("dst") == node)).agg(F.array_sort(F.collect_list("src")).alias("referred_by"))
        return one.join(F.broadcast(kids)).join(F.broadcast(out)).join(F.broadcast(into))

    def context(self, doc: str, node: str, exclude_testing: bool = True) -> DataFrame:
        seed = self.spark.createDataFrame([(doc, node)], "reg_doc string, node string")
        return graph.context(seed, self.nodes, self.ancestors, self.references, self.labels, exclude_testing)

    def get_test_procedures(self, doc: str, node: str) -> DataFrame:
        """Testing clauses in the clause's procedure context."""
        testing = self.labels.filter(F.col("category").isin(*tx.TESTING))
        return self.context(doc, node, exclude_testing=False).join(testing, ["reg_doc", "node"]).select("node", "category").orderBy(tx.natural_key(F.col("node")))

    def get_document_structure(self, doc: str, section: str | None = None) -> DataFrame:
        """Outline of the top sections with counts, or one section's subtree in order."""
        counts = search.outline(self.ancestors, self.labels)
        rows = self.nodes.filter(F.col("reg_doc") == doc).join(self.index.select("reg_doc", "node", "title"), ["reg_doc", "node"], "left").join(counts, ["reg_doc", "node"], "left").na.fill(0, ["descendants", "testable"])
        if section is None:
            rows = rows.join(self.ancestors.select("reg_doc", "node"), ["reg_doc", "node"], "left_anti")
        else:
            below = self.ancestors.filter(F.col("ancestor") == section).select("reg_doc", "node")
            rows = rows.filter(F.col("node") == section).unionByName(rows.join(below, ["reg_doc", "node"], "left_semi"))
        return rows.select("node", "title", "descendants", "testable").orderBy(tx.natural_key(F.col("node")))

    def get_performance_table(self, doc: str, node: str) -> DataFrame:
        rows = self._table("regulation_tables").dropDuplicates(["table_id"]).filter((F.col("reg_doc") == doc) & (tx.canonical_id(F.col("owner_clause_id")) == node))
        return rows.select("table_id", "title", links.table_text(F.col("row_maps"), hide_empty=False).alias("text"))

    def list_existing_test_cases(self, doc: str, nodes: list[str] | None = None, most: int = 30) -> DataFrame:
        """At most ``most`` cases that name one of ``nodes``, with how many there are in all."""
        cases = self._table("test_cases").dropDuplicates(["test_id"]).filter(F.col("reg_doc") == doc)
        if nodes is not None:
            cases = cases.filter(F.arrays_overlap(F.transform("source_clause_ids", tx.canonical_id), F.array(*[F.lit(n) for n in nodes])))
        total = cases.agg(F.count("*").alias("total"))
        return cases.select("test_id", "title", "source_clause_ids").orderBy("test_id").limit(most).join(F.broadcast(total))
