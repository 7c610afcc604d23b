"""Registry and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierlake.operators import projects as pj, registry as rg
from dossierlake.operators import chunking as ck
from workload import fixtures as fx, sqltext as q
from workload.kit import query

META = [fx.DOC_META]


@query("cat_list_docs", q.with_(META, """
SELECT doc_id, file_name, doc_type, project_id, count(*) OVER () AS total FROM doc_meta"""))
def cat_list_docs(spark, sf):
    return rg.list_documents(fx.doc_meta(spark, sf).select("doc_id", "file_name", "doc_type", "project_id"))


@query("cat_get_doc", q.with_([*META, """regs AS (SELECT doc_id, file_name, doc_type, 0 AS ord FROM doc_meta
  UNION ALL SELECT doc_id, 'again.pdf', 'rc', 1 FROM labels)""",
  "asked AS (SELECT doc_id FROM labels UNION SELECT -1 - doc_id FROM labels)"], """
SELECT a.doc_id, f.doc_id IS NOT NULL AS found, file_name, doc_type FROM asked a LEFT JOIN
  (SELECT doc_id, min_by(file_name, ord) AS file_name, min_by(doc_type, ord) AS doc_type FROM regs GROUP BY 1) f USING (doc_id)"""))
def cat_get_doc(spark, sf):
    """Lookups of all labelled ids and of as many unknown ones."""
    known = fx.table(spark, sf, "labels").select("doc_id")
    asked = known.union(known.select(-1 - F.col("doc_id")))
    return rg.get_documents(fx.registrations(spark, sf), asked, "ord")


@query("cat_full_text", "SELECT l.doc_id, d.text AS full_text FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)")
def cat_full_text(spark, sf):
    return rg.full_text(fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels"))


@query("cat_delete_doc", q.with_([*q.chunk_ctes(), *META, "gone AS (SELECT doc_id FROM labels WHERE toxic = 1)"], """
SELECT 'registry' AS kept_in, doc_id, 0 AS item FROM doc_meta WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'chunks', doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'vectors', vec_id, 0 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM gone)"""))
def cat_delete_doc(spark, sf):
    """Erasure of all toxic documents from registry, chunks and vectors."""
    tables = {
        "registry": fx.doc_meta(spark, sf).select("doc_id", F.lit(0).alias("item")),
        "chunks": ck.retrieval_chunks(fx.documents(spark, sf)).select("doc_id", F.col("chunk_index").alias("item")),
        "vectors": fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("item")),
    }
    kept = rg.erase(tables, fx.table(spark, sf, "labels").filter("toxic = 1"))
    parts = [df.select(F.lit(name).alias("kept_in"), "doc_id", F.col("item").cast("long")) for name, df in kept.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("cat_where_filter", q.with_(META, """
SELECT doc_id, doc_type, project_id FROM doc_meta WHERE doc_type = 'programme' AND project_id = 3
UNION ALL SELECT doc_id, doc_type, project_id FROM doc_meta WHERE doc_type = 'rc' AND project_id IS NULL"""))
def cat_where_filter(spark, sf):
    meta = fx.doc_meta(spark, sf).select("doc_id", "doc_type", "project_id")
    both = rg.where({"$and": [{"doc_type": "programme"}, {"project_id": 3}]})
    return meta.filter(both).union(meta.filter(rg.where({"doc_type": "rc", "project_id": None})))


@query("cat_doc_scope", q.with_([*q.chunk_ctes(), *META], """
SELECT doc_id, chunk_index FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND doc_id IN (SELECT doc_id FROM doc_meta WHERE doc_type = 'memoire')"""))
def cat_doc_scope(spark, sf):
    docs = fx.documents(spark, sf).join(fx.doc_meta(spark, sf).select("doc_id", "doc_type"), "doc_id")
    chunks = ck.retrieval_chunks(docs.select("doc_id", "doc_type", "text"), keep=("doc_type",))
    out = rg.doc_scope(chunks, fx.table(spark, sf, "labels").filter("quality = 1"), {"doc_type": "memoire"})
    return out.select("doc_id", F.col("chunk_index").cast("long"))


@query("cat_search_box", q.with_([*META, fx.PROJECTS], """
SELECT 'document' AS kind, doc_id AS id, file_name AS name FROM doc_meta
  WHERE contains(lower(doc_id::VARCHAR), 'src1_') OR contains(lower(file_name), 'src1_')
UNION ALL SELECT 'project', project_id, name FROM projects WHERE contains(project_id::VARCHAR, 'mach')
  OR contains(lower(name), 'mach') OR contains(lower(client_name), 'mach')"""))
def cat_search_box(spark, sf):
    docs = rg.search_box(fx.doc_meta(spark, sf), "  SRC1_ ", ["doc_id", "file_name"])
    prjs = rg.search_box(fx.projects(spark, sf), "Mach", ["project_id", "name", "client_name"])
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("file_name").alias("name")).union(
        prjs.select(F.lit("project"), "project_id", "name"))


@query("cat_paginate", """
SELECT doc_id, position, ((position - 1) // 100) + 1 AS page_no FROM
  (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents)""")
def cat_paginate(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return rg.paginate(docs, [F.desc("n_chars"), F.col("doc_id")], rg.DOCUMENT_PAGE).select("doc_id", "position", "page_no")


_LISTED = """listed AS (SELECT p.project_id, name, client_name, strftime(created_at, '%Y-%m-%d') AS created_at,
  count(doc_id) OVER (PARTITION BY p.project_id) AS n_documents, doc_id, doc_type FROM projects p LEFT JOIN project_documents d USING (project_id))"""


def _listed(df):
    return df.select("project_id", "name", "client_name", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"), "n_documents", "doc_id", "doc_type")


@query("prj_list", q.with_([fx.PROJECTS, fx.PROJECT_DOCUMENTS, _LISTED], "SELECT * FROM listed"))
def prj_list(spark, sf):
    return _listed(pj.list_projects(fx.projects(spark, sf), fx.project_documents(spark, sf)))


@query("prj_get", q.with_([fx.PROJECTS, fx.PROJECT_DOCUMENTS, _LISTED], "SELECT * FROM listed WHERE project_id IN (SELECT doc_id FROM labels)"))
def prj_get(spark, sf):
    asked = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("project_id"))
    return _listed(pj.get_projects(fx.projects(spark, sf), fx.project_documents(spark, sf), asked))


@query("prj_create", q.with_([fx.PROJECTS], """
SELECT name, client_name, status, true AS has_id, created_at = updated_at AS fresh FROM projects
UNION ALL SELECT p_name, p_mfgr, 'active', true, true FROM part"""
  .replace("p_name", "'part ' || p_partkey").replace("p_mfgr", "NULL")))
def prj_create(spark, sf):
    """One new project per part."""
    asked = fx.table(spark, sf, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"),
                                               F.lit(None).cast("string").alias("client_name"))
    out = pj.create_projects(fx.projects(spark, sf), asked)
    return out.select("name", "client_name", "status", F.col("project_id").isNotNull().alias("has_id"),
                      (F.col("created_at") == F.col("updated_at")).alias("fresh"))


@query("prj_attach", q.with_([fx.PROJECT_DOCUMENTS], """
SELECT project_id, doc_id, doc_type FROM project_documents
UNION ALL SELECT doc_id, -doc_id, CASE WHEN quality = 1 THEN 'rc' ELSE 'unspecified' END FROM labels"""))
def prj_attach(spark, sf):
    asked = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("project_id"), (-F.col("doc_id")).alias("doc_id"), F.when(F.col("quality") == 1, "rc").alias("doc_type"))
    return pj.attach_documents(fx.project_documents(spark, sf), asked).select("project_id", "doc_id", "doc_type")


@query("prj_update", q.with_([fx.PROJECTS], """
SELECT project_id, CASE WHEN c_acctbal < 0 AND project_id % 2 = 0 THEN upper(name) || '!' ELSE name END AS name,
  CASE WHEN c_acctbal < 0 AND project_id % 2 = 1 THEN NULL ELSE client_name END AS client_name,
  CASE WHEN c_acctbal < 0 THEN 'archived' ELSE status END AS status, c_acctbal < 0 OR updated_at IS NULL AS bumped
FROM projects JOIN customer ON c_custkey = project_id"""))
def prj_update(spark, sf):
    """Projects of customers in debt are renamed or lose their client, in two patches each."""
    debt = fx.table(spark, sf, "customer").filter("c_acctbal < 0")
    key, at = F.col("c_custkey"), F.lit("2030-01-01").cast("timestamp")
    first = debt.select(key.alias("project_id"), F.lit(1).alias("seq"), at.alias("at"),
                        F.create_map(F.lit("name"), F.lower("c_name"), F.lit("status"), F.lit("archived")).alias("fields"))
    first = first.filter(F.col("project_id") % 2 == 0).unionByName(
        first.filter(F.col("project_id") % 2 == 1).withColumn(
            "fields", F.create_map(F.lit("client_name"), F.lit(None).cast("string"), F.lit("status"), F.lit("archived"))))
    second = debt.filter(key % 2 == 0).select(
        key.alias("project_id"), F.lit(2).alias("seq"), at.alias("at"),
        F.create_map(F.lit("name"), F.concat(F.upper("c_name"), F.lit("!"))).alias("fields"))
    out = pj.update_projects(fx.projects(spark, sf), first.unionByName(second))
    return out.select("project_id", "name", "client_name", "status",
                      F.coalesce(F.year("updated_at") == 2030, F.lit(True)).alias("bumped"))


_DETACH = "asked AS (SELECT o_custkey AS project_id, o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT -1, doc_id FROM labels)"


@query("prj_detach", q.with_([fx.PROJECT_DOCUMENTS, _DETACH], """
SELECT 'kept' AS state, project_id, doc_id FROM project_documents p
  WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.project_id = p.project_id AND a.doc_id = p.doc_id)
UNION ALL SELECT 'missing', project_id, doc_id FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM project_documents p WHERE a.project_id = p.project_id AND a.doc_id = p.doc_id)"""))
def prj_detach(spark, sf):
    orders = fx.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    asked = orders.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("doc_id")).union(
        fx.table(spark, sf, "labels").select(F.lit(-1).cast("long"), "doc_id"))
    kept, missing = pj.detach_documents(fx.project_documents(spark, sf), asked)
    return kept.select(F.lit("kept").alias("state"), "project_id", "doc_id").union(
        missing.select(F.lit("missing"), "project_id", "doc_id"))


@query("prj_delete_cascade", q.with_([fx.PROJECTS, fx.PROJECT_DOCUMENTS], """
SELECT 'project' AS kind, project_id, NULL::BIGINT AS doc_id FROM projects
  WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
UNION ALL SELECT 'document', project_id, doc_id FROM project_documents
  WHERE project_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"""))
def prj_delete_cascade(spark, sf):
    gone = fx.projects(spark, sf).filter("client_name = 'MACHINERY'")
    prjs, docs = pj.delete_projects(fx.projects(spark, sf), fx.project_documents(spark, sf), gone)
    return prjs.select(F.lit("project").alias("kind"), "project_id", F.lit(None).cast("long").alias("doc_id")).union(
        docs.select(F.lit("document"), "project_id", "doc_id"))


@query("prj_validate_refs", q.with_([fx.PROJECT_DOCUMENTS], """
SELECT project_id, doc_id FROM project_documents WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""))
def prj_validate_refs(spark, sf):
    out = pj.dangling(fx.project_documents(spark, sf), fx.table(spark, sf, "documents"), "doc_id")
    return out.select("project_id", "doc_id")
