"""Claims, evidence, questions and roles derived from the order tables, so that they grow with the data.

A claim is a customer's year of orders, an evidence record is an order: the priority decides the kind of evidence, the
status the verdict, the price whether it is stale. A question is a part that rests on the claims of its orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.evidence import audit as A
from attest.evidence import claims as C
from attest.evidence import indexes as X
from attest.evidence import roles as R
from attest.evidence import runner
from attest.evidence import status as S
from attest.evidence.templates import TEMPLATES
from attest.functions.frames import union_all
from workload.base import query, table

# The SQL text of a mapping, and the same mapping as an expression.
TYPES = {"1-URGENT": "probe_result", "2-HIGH": "confirmation", "3-MEDIUM": "testimonial", "4-NOT SPECIFIED": "declaration",
         "5-LOW": "document_anchor"}
ACTORS = {"1-URGENT": "probe", "2-HIGH": "human", "3-MEDIUM": "human", "4-NOT SPECIFIED": "system", "5-LOW": "system"}
VERDICTS = {"F": "fail", "O": "pass", "P": "inconclusive"}
TEMPLATE_OF = {"view": "anti_join", "click": "duplicate", "error": "balance", "signup": "ic_symmetry", "purchase": "coverage"}
PREDICATE_OF = {"AUTOMOBILE": "references", "BUILDING": "unique_key", "FURNITURE": "covers", "HOUSEHOLD": "semantic_equivalent"}
DECISION_OF = {"F": "unbindable", "O": "skipped", "P": "semantic_only"}


def mapped(column, pairs: dict):
    expression = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in pairs.items():
        expression = expression.when(column == key, value)
    return expression


def case(column: str, pairs: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def claim_of(custkey, date):
    return F.concat(F.lit("C"), custkey.cast("string"), F.lit("Y"), F.year(date).cast("string"))


CLAIM_OF = "'C' || o_custkey || 'Y' || year(o_orderdate)"


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    is_probe = F.col("o_orderpriority") == "1-URGENT"
    none = F.lit(None).cast("string")
    return o.select(
        F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("id"),
        mapped(F.col("o_orderpriority"), TYPES).alias("type"), mapped(F.col("o_orderpriority"), ACTORS).alias("actor"),
        claim_of(F.col("o_custkey"), F.col("o_orderdate")).alias("claim_id"),
        F.when(is_probe, F.concat(F.lit("P"), F.col("o_orderkey").cast("string"))).alias("probe_id"),
        F.when(is_probe, mapped(F.col("o_orderstatus"), VERDICTS)).alias("verdict"),
        F.struct(F.when(F.col("o_orderstatus") == "F", "DE").alias("entity"), none.alias("period"), none.alias("segment")).alias("scope"),
        F.when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") != "P"), "said so").alias("statement"),
        F.col("o_orderkey").alias("population"), F.col("o_custkey").alias("exception_count"),
        F.array().cast("array<map<string,string>>").alias("exception_samples"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.create_map(
            F.lit("decision"), mapped(F.col("o_orderstatus"), DECISION_OF), F.lit("source"), F.lit("orders"),
            F.lit("table"), F.lit("orders"), F.lit("column"), F.col("o_orderstatus"),
            F.lit("reason"), F.concat(F.lit("seen in order "), F.col("o_orderkey").cast("string")))).alias("payload"),
        F.create_map(F.lit("orders"), F.date_format("o_orderdate", "yyyy-MM")).alias("source_fingerprints"),
        (F.col("o_totalprice") > 300000).alias("stale"), F.col("o_orderdate").alias("created_at"))


EV = f"""ev AS (SELECT 'E' || o_orderkey AS id, {case('o_orderpriority', TYPES)} AS type, {case('o_orderpriority', ACTORS)} AS actor,
    {CLAIM_OF} AS claim_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'P' || o_orderkey END AS probe_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN {case('o_orderstatus', VERDICTS)} END AS verdict,
    o_orderstatus = 'F' AS scoped, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'P' THEN 'said so' END AS statement,
    o_orderkey AS population, o_custkey AS exception_count, o_totalprice > 300000 AS stale, o_orderdate AS created_at, o_orderstatus AS st
    FROM orders)"""


def claims(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    years = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(
        F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))
    return years.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("Y"), F.col("y").cast("string")).alias("id"),
        F.when(F.col("c_nationkey") < 20, "ai").otherwise("human").alias("created_by"),
        mapped(F.col("c_mktsegment"), PREDICATE_OF).alias("predicate"),
        F.concat(F.lit('{"nation": "'), F.col("c_nationkey").cast("string"), F.lit('"}')).alias("params"),
        F.when(F.col("y") < 1998, F.struct(F.lit("DE").alias("entity"), F.lit(None).cast("string").alias("period"),
                                           F.lit(None).cast("string").alias("segment"))).alias("scope"),
        F.when(F.col("y") > 1999, F.struct(F.col("y").cast("string").alias("valid_from"),
                                           F.lit(None).cast("string").alias("valid_to"))).alias("validity"),
        F.array(F.lit("S2"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))).alias("source_ids"),
        F.array(F.concat(F.lit("E"), F.col("first_order").cast("string")),
                F.concat(F.lit("E"), (F.col("last_order") + 1).cast("string"))).alias("evidence_ids"),
        F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("Y"),
                         (F.col("y") - 1).cast("string"))).alias("depends_on"),
        F.when(F.col("y") > 1996, F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("Y1996"))).alias("derived_from"),
        F.concat(F.lit("E"), F.col("first_order").cast("string")).alias("derived_from_evidence"),
        F.concat_ws(" ", F.lit("customer"), "c_name", "c_mktsegment").alias("statement"),
        F.col("y").alias("y"), F.col("o_custkey").alias("cust"),
        F.make_timestamp_ntz(F.col("y"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"))


CL = f"""cl AS (SELECT 'C' || o_custkey || 'Y' || y AS id, CASE WHEN c_nationkey < 20 THEN 'ai' ELSE 'human' END AS created_by,
    {case('c_mktsegment', PREDICATE_OF)} AS predicate, '{{"nation": "' || c_nationkey || '"}}' AS params, y, o_custkey AS cust, c_nationkey AS nk,
    'E' || first_order AS ev1, 'E' || (last_order + 1) AS ev2, 'C' || o_custkey || 'Y' || (y - 1) AS dep,
    CASE WHEN y > 1996 THEN 'C' || o_custkey || 'Y1996' END AS derived_from, 'customer ' || c_name || ' ' || c_mktsegment AS statement
    FROM (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders GROUP BY 1, 2)
    JOIN customer ON o_custkey = c_custkey)"""

FACTS = """facts AS (SELECT claim_id,
    count(*) FILTER (type = 'probe_result' AND verdict = 'pass' AND NOT stale) AS probe_pass,
    count(*) FILTER (type = 'probe_result' AND verdict = 'fail' AND NOT stale) AS probe_fail,
    count(*) FILTER (type = 'confirmation' AND NOT stale) AS confirmations,
    count(*) FILTER (type = 'confirmation' AND scoped AND NOT stale) AS scoped_confirmations,
    count(*) FILTER (type = 'testimonial' AND NOT stale) AS testimonials,
    count(*) FILTER (type = 'probe_result') AS probe_results, count(*) FILTER (actor = 'probe') AS by_probe
    FROM ev GROUP BY 1)"""
STATUS = """CASE
    WHEN probe_fail > 0 AND (probe_pass > 0 OR testimonials > 0 OR ok > 0) THEN 'unresolved'
    WHEN probe_fail > 0 THEN 'contradicted' WHEN ok > 0 THEN 'business-confirmed' WHEN probe_pass > 0 THEN 'tested' ELSE 'inferred' END"""
RESOLVED = f"""{EV}, {CL}, {FACTS}, resolved AS (SELECT *, {STATUS} AS status FROM (
    SELECT cl.*, coalesce(probe_pass, 0) AS probe_pass, coalesce(probe_fail, 0) AS probe_fail, coalesce(confirmations, 0) AS confirmations,
           coalesce(testimonials, 0) AS testimonials, coalesce(probe_results, 0) AS probe_results, coalesce(by_probe, 0) AS by_probe,
           CASE WHEN testimonials > 0 THEN scoped_confirmations ELSE coalesce(confirmations, 0) END AS ok
    FROM cl LEFT JOIN facts ON claim_id = cl.id))"""


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    return S.resolve_status(claims(spark, sf), evidence(spark, sf))


@query("claim_status", f"WITH {RESOLVED} SELECT id, status FROM resolved")
def claim_status(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("id", "status")


@query("claim_status_listed", f"""
    WITH {EV}, {CL}, links AS (SELECT id AS claim_id, ev1 AS eid FROM cl UNION SELECT id, ev2 FROM cl),
    f AS (SELECT l.claim_id, bool_or(type = 'probe_result' AND verdict = 'fail' AND NOT stale) AS bad,
      bool_or(type = 'probe_result' AND verdict = 'pass' AND NOT stale) AS good, bool_or(type = 'testimonial' AND NOT stale) AS said,
      bool_or(type = 'confirmation' AND NOT stale) AS conf, bool_or(type = 'confirmation' AND NOT stale AND scoped) AS sconf
      FROM links l JOIN ev ON ev.id = l.eid GROUP BY 1)
    SELECT cl.id, CASE WHEN bad AND (good OR said OR sconf OR conf) THEN 'unresolved' WHEN bad THEN 'contradicted'
      WHEN sconf OR (conf AND NOT said) THEN 'business-confirmed' WHEN good THEN 'tested' ELSE 'inferred' END AS status
    FROM cl LEFT JOIN f ON f.claim_id = cl.id""")
def claim_status_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that list their evidence ids, among them ids of other claims' records and ids of none."""
    c, e = claims(spark, sf), evidence(spark, sf)
    return S.resolve_status(c, S.attached(e, S.attachments(c))).select("id", "status")


@query("status_counts", f"WITH {RESOLVED} SELECT status, count(*) AS n FROM resolved GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.status_counts(resolved(spark, sf))


@query("evidence_counts", f"WITH {EV} SELECT type, actor, count(*) AS n FROM ev GROUP BY 1, 2")
def evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return runner.evidence_counts(evidence(spark, sf))


def _trail(name: str, word: str) -> str:
    return f"CASE WHEN {name} > 0 THEN {name} || ' {word}' || CASE WHEN {name} = 1 THEN '' ELSE 's' END END"


@query("status_rationale", f"""
    WITH {RESOLVED}, t AS (SELECT id, status, concat_ws(', ', {_trail('probe_pass', 'passing probe result')},
      {_trail('probe_fail', 'failing probe result')}, {_trail('confirmations', 'confirmation')}, {_trail('testimonials', 'testimonial')}) AS trail FROM resolved)
    SELECT id, CASE status WHEN 'unresolved' THEN 'Conflict is present: at least one failing probe coexists with supporting evidence.'
      WHEN 'contradicted' THEN 'At least one failing probe is present and no competing supporting evidence remains live.'
      WHEN 'business-confirmed' THEN 'At least one admissible human confirmation is live and no failing probe overrides it.'
      WHEN 'tested' THEN 'At least one passing probe is live and no failing probe overrides it.'
      ELSE 'Nothing stronger than inferred evidence is live yet.' END || ' Live trail: ' ||
      CASE WHEN trail = '' THEN 'no live status-bearing evidence' ELSE trail END || '.' AS rationale FROM t""")
def status_rationale(spark: SparkSession, sf: str) -> DataFrame:
    return S.rationale(resolved(spark, sf)).select("id", "rationale")


@query("rejected_confirmations", f"""
    WITH {EV}, said AS (SELECT DISTINCT claim_id FROM ev WHERE type = 'testimonial' AND NOT stale)
    SELECT id, claim_id FROM ev WHERE type = 'confirmation' AND NOT scoped AND claim_id IN (SELECT claim_id FROM said)""")
def rejected_confirmations(spark: SparkSession, sf: str) -> DataFrame:
    return S.admissible(evidence(spark, sf)).filter("NOT admitted").select("id", "claim_id")


@query("stale_evidence", """
    WITH now AS (SELECT 'orders' AS view, strftime(max(o_orderdate), '%Y-%m') AS fp FROM orders)
    SELECT 'E' || o_orderkey AS id FROM orders, now WHERE strftime(o_orderdate, '%Y-%m') IS DISTINCT FROM fp""")
def stale_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every record carries the month it saw; only those of the latest month are still current."""
    current = table(spark, sf, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("fingerprint")).select(
        F.lit("orders").alias("view"), "fingerprint")
    return S.stale_evidence(evidence(spark, sf), current).filter("changed").select("id")


def question_links(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        claim_of(F.col("o_custkey"), F.col("o_orderdate")).alias("claim_id"),
        F.concat(F.lit("Q"), F.col("l_partkey").cast("string")).alias("question_id"))


QL = f"ql AS (SELECT DISTINCT {CLAIM_OF} AS claim_id, 'Q' || l_partkey AS question_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("gap_load", f"""
    WITH {RESOLVED}, {QL}, load AS (SELECT claim_id, count(*) AS n FROM ql GROUP BY 1)
    SELECT id, status, coalesce(n, 0) AS n_questions FROM resolved LEFT JOIN load ON claim_id = id
    WHERE status NOT IN ('tested', 'business-confirmed')""")
def gap_load(spark: SparkSession, sf: str) -> DataFrame:
    return C.gap_load(resolved(spark, sf), question_links(spark, sf))


@query("questions_resting_on", "WITH q AS (SELECT 'Q' || conv_id AS question_id, 'C' || turn AS claim_id FROM conversations) "
       "SELECT DISTINCT claim_id, question_id FROM q")
def questions_resting_on(spark: SparkSession, sf: str) -> DataFrame:
    return C.questions_resting_on(questions(spark, sf))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question per turn of a conversation, so claim lists stay short however long a conversation is."""
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("Q"), F.col("conv_id").cast("string")).alias("id"), F.col("text").alias("question"),
        F.array(F.concat(F.lit("C"), F.col("turn").cast("string"))).alias("claim_ids"), F.lit(False).alias("stale"))


@query("ready_claims", f"""
    WITH {RESOLVED} SELECT a.id AS claim_id, coalesce(b.status IN ('tested', 'business-confirmed'), false) AS ready
    FROM resolved a LEFT JOIN resolved b ON a.dep = b.id""")
def ready_claims(spark: SparkSession, sf: str) -> DataFrame:
    judged = resolved(spark, sf)
    edges = judged.select(F.col("id").alias("claim_id"), F.explode("depends_on").alias("depends_on"))
    return C.ready_for_probe(edges, judged)


def landscape_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Region, nation, customer, order; orders also depend on region 0 directly, a prerequisite many claims share."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    edge = lambda df, a, b: df.select(a.alias("claim_id"), b.alias("depends_on"))
    return union_all([
        edge(n, name("n", "n_nationkey"), name("r", "n_regionkey")),
        edge(c, name("c", "c_custkey"), name("n", "c_nationkey")),
        edge(o, name("o", "o_orderkey"), name("c", "o_custkey")),
        edge(o, name("o", "o_orderkey"), F.lit("r0")),
    ])


EDGES = """edges AS (SELECT 'n' || n_nationkey AS claim_id, 'r' || n_regionkey AS dep FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'o' || o_orderkey, 'r0' FROM orders)"""


@query("claim_levels", f"""
    WITH RECURSIVE {EDGES}, walk(claim_id, level) AS (
      SELECT 'r' || r_regionkey, 0 FROM region
      UNION ALL SELECT e.claim_id, w.level + 1 FROM walk w JOIN edges e ON e.dep = w.claim_id)
    SELECT claim_id, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY 1""")
def claim_levels(spark: SparkSession, sf: str) -> DataFrame:
    edges = landscape_edges(spark, sf)
    regions = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("claim_id"))
    return C.dependency_levels(regions.unionByName(edges.select("claim_id").distinct()), edges)


KEY = """sha256('{"params": ' || coalesce(params, '{}') || ', "predicate": "' || predicate || '", "scope": ' ||
    CASE WHEN y < 1998 THEN '{"entity": "DE", "period": null, "segment": null}' ELSE 'null' END ||
    ', "sources": [' || CASE WHEN 'S2' <= 'S' || nk THEN '"S2", "S' || nk || '"' ELSE '"S' || nk || '", "S2"' END || '], "validity": ' ||
    CASE WHEN y > 1999 THEN '{"valid_from": "' || y || '", "valid_to": null}' ELSE 'null' END || '}')"""


@query("claim_keys", f"WITH {CL} SELECT id, CASE WHEN predicate IS NOT NULL THEN {KEY} END AS claim_key FROM cl")
def claim_keys(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_key(claims(spark, sf)).select("id", "claim_key")


@query("claim_dedupe", f"""
    WITH {CL}, k AS (SELECT id, y, CASE WHEN predicate IS NOT NULL THEN {KEY} END AS key FROM cl),
    stored AS (SELECT DISTINCT key FROM k WHERE y = 1995)
    SELECT arg_min(id, (y, id)) AS id, key AS claim_key FROM k WHERE y > 1995 AND key IS NOT NULL
      AND key NOT IN (SELECT key FROM stored WHERE key IS NOT NULL) GROUP BY key
    UNION ALL SELECT id, key FROM k WHERE y > 1995 AND key IS NULL""")
def claim_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of 1995 are stored; later proposals enter only if they say something new."""
    c = claims(spark, sf)
    return C.insert_claims(c.filter("y = 1995"), c.filter("y > 1995")).select("id", "claim_key")


@query("escalated_claims", f"""
    WITH {EV}, {CL} SELECT 'X' || ev.id AS id, cl.id AS derived_from, ev.id AS derived_from_evidence, 'inferred' AS status,
      CASE WHEN cl.y < 1998 THEN 'DE' END AS entity FROM cl JOIN ev ON ev.id IN (cl.ev1, cl.ev2)
    WHERE ev.type = 'probe_result' AND ev.verdict = 'fail'""")
def escalated_claims(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None)
    e = evidence(spark, sf)
    findings = e.filter((F.col("type") == "probe_result") & (F.col("verdict") == "fail")).select(
        F.col("id").alias("evidence_id"), F.concat(F.lit("X"), "id").alias("id"), F.lit("pattern").alias("statement"),
        F.lit("ai").alias("created_by"), none.cast("string").alias("predicate"), none.cast("string").alias("params"),
        none.cast(S.S.SCOPE).alias("scope"), none.cast(S.S.VALIDITY).alias("validity"))
    return C.escalate(claims(spark, sf), e, findings).select(
        "id", "derived_from", "derived_from_evidence", "status", F.col("scope.entity").alias("entity"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("id"),
        mapped(F.col("event_type"), TEMPLATE_OF).alias("template"),
        F.concat(F.lit("C"), F.col("user_id").cast("string"), F.lit("Y1997")).alias("claim_id"), F.col("props").alias("params"))


PR = f"pr AS (SELECT 'P' || event_id AS id, {case('event_type', TEMPLATE_OF)} AS template, 'C' || user_id || 'Y1997' AS claim_id FROM events)"


@query("template_counts", f"WITH {PR} SELECT template, count(*) AS n FROM pr GROUP BY 1")
def template_counts(spark: SparkSession, sf: str) -> DataFrame:
    return runner.template_counts(probes(spark, sf))


@query("evidence_violations", f"""
    WITH {EV} SELECT id, 'statement_missing' AS violation FROM ev WHERE type = 'testimonial' AND statement IS NULL
    UNION ALL SELECT id, 'more_exceptions_than_rows' FROM ev WHERE exception_count > population""")
def evidence_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.evidence_violations(evidence(spark, sf))


@query("integrity", f"""
    WITH {EV}, {CL}, {PR},
    src AS (SELECT 'S' || n_nationkey AS id FROM nation WHERE n_regionkey > 0),
    refs AS (
      SELECT 'claim' AS owner, id AS owner_id, 'dependency' AS edge, dep AS missing, 'c' AS target FROM cl
      UNION ALL SELECT 'claim', id, 'parent', derived_from, 'c' FROM cl
      UNION ALL SELECT 'evidence', id, 'claim', claim_id, 'c' FROM ev
      UNION ALL SELECT 'probe', id, 'claim', claim_id, 'c' FROM pr
      UNION ALL SELECT 'question', 'Q' || conv_id, 'claim', 'C' || turn, 'c' FROM conversations
      UNION ALL SELECT 'claim', id, 'evidence', ev1, 'e' FROM cl UNION ALL SELECT 'claim', id, 'evidence', ev2, 'e' FROM cl
      UNION ALL SELECT 'claim', id, 'origin evidence', ev1, 'e' FROM cl
      UNION ALL SELECT 'claim', id, 'source', 'S2', 's' FROM cl UNION ALL SELECT 'claim', id, 'source', 'S' || nk, 's' FROM cl
      UNION ALL SELECT 'profile', 'F' || p_partkey, 'source', 'S' || p_size, 's' FROM part
      UNION ALL SELECT 'evidence', id, 'probe', probe_id, 'p' FROM ev),
    known AS (SELECT 'c' AS target, id FROM cl UNION ALL SELECT 'e', id FROM ev UNION ALL SELECT 's', id FROM src UNION ALL SELECT 'p', id FROM pr)
    SELECT owner, owner_id, edge, missing FROM refs r WHERE missing IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM known k WHERE k.target = r.target AND k.id = r.missing)""")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    profiles = table(spark, sf, "part").select(key("F", "p_partkey").alias("id"), key("S", "p_size").alias("source_id"))
    sources = table(spark, sf, "nation").filter("n_regionkey > 0").select(key("S", "n_nationkey").alias("id"))
    return C.dangling(claims(spark, sf), evidence(spark, sf), probes(spark, sf), questions(spark, sf), profiles, sources)


@query("claim_dependants", f"WITH {CL} SELECT dep AS claim_id, id AS dependant_id FROM cl")
def claim_dependants(spark: SparkSession, sf: str) -> DataFrame:
    return X.dependants(claims(spark, sf))


@query("derived_children", f"WITH {CL} SELECT derived_from AS claim_id, id AS child_id FROM cl WHERE derived_from IS NOT NULL")
def derived_children(spark: SparkSession, sf: str) -> DataFrame:
    return X.derived_children(claims(spark, sf))


@query("claims_by_source", f"WITH {CL} SELECT 'S2' AS source_id, id AS claim_id FROM cl UNION ALL SELECT 'S' || nk, id FROM cl")
def claims_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return X.claims_by_source(claims(spark, sf))


@query("evidence_by_claim", f"""
    WITH {EV}, {CL} SELECT DISTINCT cl.id AS claim_id, ev.id AS evidence_id FROM cl JOIN ev ON ev.id IN (ev1, ev2)""")
def evidence_by_claim(spark: SparkSession, sf: str) -> DataFrame:
    return X.evidence_by_claim(claims(spark, sf), evidence(spark, sf))


@query("declarations_by_column", f"""
    WITH {EV} SELECT 'orders' AS source, 'orders' AS "table", st AS "column", id AS evidence_id FROM ev WHERE type = 'declaration'""")
def declarations_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return X.declarations_by_column(evidence(spark, sf))


@query("fingerprint_names", "SELECT 'orders' AS name")
def fingerprint_names(spark: SparkSession, sf: str) -> DataFrame:
    return X.fingerprint_names(evidence(spark, sf))


STAGED = f"""{RESOLVED}, {PR}, dec AS (SELECT claim_id, arg_min({case('st', DECISION_OF)}, (created_at, id)) AS decision,
      arg_min('seen in order ' || population, (created_at, id)) AS reason FROM ev WHERE type = 'declaration' GROUP BY 1),
    pe AS (SELECT DISTINCT claim_id FROM ev WHERE probe_id IS NOT NULL UNION SELECT claim_id FROM pr),
    staged AS (SELECT r.*, coalesce(reason, '') AS no_probe_reason, CASE WHEN pe.claim_id IS NOT NULL THEN 'bound' WHEN decision IS NOT NULL THEN decision
      WHEN predicate IS NULL OR predicate = 'semantic_equivalent' THEN 'semantic_only' ELSE 'unbound' END AS stage
      FROM resolved r LEFT JOIN pe ON pe.claim_id = r.id LEFT JOIN dec ON dec.claim_id = r.id)"""


@query("funnel", f"""
    WITH {STAGED} SELECT 'proposed' AS step, 'claims' AS name, count(*) AS n FROM staged
    UNION ALL SELECT 'bound', stage, count(*) FROM staged GROUP BY 2
    UNION ALL SELECT 'judged', 'executed', count(*) FROM staged WHERE probe_results > 0 HAVING count(*) > 0
    UNION ALL SELECT 'status', status, count(*) FROM staged GROUP BY 2""")
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    testable = F.coalesce(F.col("predicate").isin("references", "unique_key", "covers"), F.lit(False))
    return A.funnel(A.claim_stages(resolved(spark, sf), evidence(spark, sf), probes(spark, sf), testable))


RATIONALE = f"""CASE status WHEN 'unresolved' THEN 'Conflict is present: at least one failing probe coexists with supporting evidence.'
      WHEN 'contradicted' THEN 'At least one failing probe is present and no competing supporting evidence remains live.'
      WHEN 'business-confirmed' THEN 'At least one admissible human confirmation is live and no failing probe overrides it.'
      WHEN 'tested' THEN 'At least one passing probe is live and no failing probe overrides it.'
      ELSE 'Nothing stronger than inferred evidence is live yet.' END || ' Live trail: ' || coalesce(nullif(concat_ws(', ',
      {_trail('probe_pass', 'passing probe result')}, {_trail('probe_fail', 'failing probe result')}, {_trail('confirmations', 'confirmation')},
      {_trail('testimonials', 'testimonial')}), ''), 'no live status-bearing evidence') || '.'"""


@query("claim_headlines", f"""
    WITH {STAGED} SELECT id, stage, no_probe_reason, CASE WHEN status = 'inferred' AND stage <> 'bound' THEN 'Never tested — ' ||
      {case('stage', A.STAGE_LABELS)} || '.' ELSE {RATIONALE} END AS headline FROM staged""")
def claim_headlines(spark: SparkSession, sf: str) -> DataFrame:
    """The line to stop reading after: why a claim was never tested, or what its evidence says."""
    testable = F.coalesce(F.col("predicate").isin("references", "unique_key", "covers"), F.lit(False))
    staged = A.claim_stages(resolved(spark, sf), evidence(spark, sf), probes(spark, sf), testable)
    return A.headlines(staged).select("id", "stage", "no_probe_reason", "headline")


@query("defeats", f"""
    WITH {EV}, {PR} SELECT ev.claim_id, ev.id AS evidence_id, coalesce(template, 'unknown template') AS template,
      CASE WHEN template IN ('balance', 'ic_symmetry', 'subledger_equals_gl') THEN 'finance' ELSE '' END AS domain,
      exception_count || ' exception' || CASE WHEN exception_count = 1 THEN '' ELSE 's' END || ' in ' || population || ' rows' AS detail
    FROM ev LEFT JOIN pr ON pr.id = ev.probe_id WHERE type = 'probe_result' AND verdict = 'fail'""")
def defeats(spark: SparkSession, sf: str) -> DataFrame:
    return A.defeats(evidence(spark, sf), probes(spark, sf))


@query("false_promotions", f"WITH {RESOLVED} SELECT id, status FROM resolved WHERE created_by = 'ai' AND status <> 'inferred' AND by_probe = 0")
def false_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed by people alone: promoted without any probe."""
    return A.false_promotions(resolved(spark, sf)).select("id", "status")


RULES = [
    ("machines", None, [["MACHINERY", "tool"]]),
    ("first customer", ["references", "unique_key"], [["Customer#000000001"]]),
    ("cars of nation 3", ["references"], [["automobile"], ['"3"', '"03"']]),
    ("nothing like it", None, [["no such token"]]),
]


@query("recall", f"""
    WITH {CL}, h AS (SELECT id, predicate, lower(statement || ' ' || params) AS t FROM cl), hits AS (
      SELECT 'machines' AS rule, id FROM h WHERE contains(t, 'machinery') OR contains(t, 'tool')
      UNION ALL SELECT 'first customer', id FROM h WHERE predicate IN ('references', 'unique_key') AND contains(t, 'customer#000000001')
      UNION ALL SELECT 'cars of nation 3', id FROM h WHERE predicate = 'references' AND contains(t, 'automobile') AND (contains(t, '"3"') OR contains(t, '"03"')))
    SELECT r.rule, min(id) IS NOT NULL AS found, min(id) AS claim_id
    FROM (VALUES ('machines'), ('first customer'), ('cars of nation 3'), ('nothing like it')) r(rule) LEFT JOIN hits USING (rule) GROUP BY 1""")
def recall(spark: SparkSession, sf: str) -> DataFrame:
    haystack = F.concat_ws(" ", "statement", "params")
    return A.recall(claims(spark, sf).withColumn("haystack", haystack), RULES)


def traps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("trap_id"),
        F.when(F.col("quality") == 1, "K6, K1").otherwise("K7").alias("category"),
        (F.col("toxic") == 0).alias("deny_promotion"), (F.col("lang") == "en").alias("detected"))


TRAPS = """traps AS (SELECT 'T' || doc_id AS trap_id, CASE WHEN quality = 1 THEN 'K6, K1' ELSE 'K7' END AS category,
    toxic = 0 AS denied, lang = 'en' AS seen FROM labels JOIN documents USING (doc_id)),
    listed AS (SELECT 'T' || doc_id AS trap_id, source FROM documents)"""


@query("expected_verdicts", f"""
    WITH {TRAPS}
    SELECT 'deny_set' AS "check", l.trap_id FROM listed l LEFT JOIN traps t USING (trap_id) WHERE source = 'src1' AND NOT coalesce(denied, false)
    UNION ALL SELECT 'recall_set', l.trap_id FROM listed l LEFT JOIN traps t USING (trap_id) WHERE source = 'src2' AND NOT coalesce(seen, false)
    UNION ALL SELECT 'k6_orphans', trap_id FROM traps WHERE category = 'K6, K1' AND denied
    UNION ALL SELECT 'k7_poisoned', trap_id FROM traps WHERE category = 'K7' AND NOT denied
    UNION ALL SELECT 'all_detected', trap_id FROM traps WHERE NOT seen""")
def expected_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    listed = table(spark, sf, "documents").select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("trap_id"), "source")
    return A.expected_verdict_findings(traps(spark, sf), listed.filter("source = 'src1'").select("trap_id"),
                                       listed.filter("source = 'src2'").select("trap_id"))


@query("trap_classes", f"""
    WITH {TRAPS} SELECT trim(c) AS class, count(*) AS n FROM (SELECT unnest(string_split(category, ',')) AS c FROM traps) GROUP BY 1""")
def trap_classes(spark: SparkSession, sf: str) -> DataFrame:
    return A.trap_class_counts(traps(spark, sf))


DECIDER_OF = {"AUTOMOBILE": "balance", "BUILDING": "fachfrage", "FURNITURE": "slot", "HOUSEHOLD": "ic_symmetry", "MACHINERY": "anti_join"}


def roles(spark: SparkSession, sf: str) -> DataFrame:
    """A role per customer, settled as its segment says, and one per supplier that nobody plays."""
    played = table(spark, sf, "customer").select(
        F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("role"), mapped(F.col("c_mktsegment"), DECIDER_OF).alias("decided_by"))
    empty = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("role"), F.lit("subledger_equals_gl").alias("decided_by"))
    return played.unionByName(empty)


ROLES = f"""roles AS (SELECT 'R' || c_custkey AS role, {case('c_mktsegment', DECIDER_OF)} AS decided_by FROM customer
    UNION ALL SELECT 'S' || s_suppkey, 'subledger_equals_gl' FROM supplier)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each year of a customer is a candidate for the customer's role, standing where its evidence puts it."""
    return resolved(spark, sf).select(
        "id", F.concat(F.lit("R"), F.col("cust").cast("string")).alias("role"), "status",
        F.create_map(F.lit("table"), F.lit("orders"), F.lit("column"), F.concat(F.lit("y"), F.col("y").cast("string"))).alias("binding"))


@query("role_lint", f"""
    WITH {ROLES} SELECT role, 'not_a_law_of_the_domain' AS violation FROM roles WHERE decided_by = 'anti_join'""")
def role_lint(spark: SparkSession, sf: str) -> DataFrame:
    return R.lint_roles(roles(spark, sf), "finance")


RANK = "CASE WHEN status IN ('tested', 'business-confirmed') THEN 0 WHEN status = 'unresolved' THEN 1 WHEN status = 'inferred' THEN 2 ELSE 3 END"


@query("role_candidates", f"""
    WITH {RESOLVED}, c AS (SELECT id, 'R' || cust AS role, status, {RANK} AS standing FROM resolved)
    SELECT role, id, status, standing, standing = 0 AND row_number() OVER (PARTITION BY role ORDER BY standing, id) = 1 AS winner FROM c""")
def role_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_candidates(candidates(spark, sf))


@query("role_election", f"""
    WITH {RESOLVED}, {PR}, c AS (SELECT r.id, 'R' || cust AS role, {RANK} AS standing, asked.claim_id IS NOT NULL AS asked,
      b.claim_id IS NOT NULL AS bound FROM resolved r
      LEFT JOIN (SELECT DISTINCT 'C' || turn || 'Y1997' AS claim_id FROM conversations) asked ON asked.claim_id = r.id
      LEFT JOIN (SELECT DISTINCT claim_id FROM pr) b ON b.claim_id = r.id)
    SELECT role, count(*) AS n_candidates, CASE WHEN min(standing) = 0 THEN 'elected' WHEN bool_or(asked) THEN 'question'
      WHEN NOT bool_or(bound) THEN 'in flight' ELSE 'lost' END AS outcome,
      CASE WHEN min(standing) = 0 THEN arg_min(id, (standing, id)) END AS elected FROM c GROUP BY 1""")
def role_election(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf).withColumn("claim_ids", F.transform("claim_ids", lambda c: F.concat(c, F.lit("Y1997"))))
    return R.role_elections(candidates(spark, sf), asked, probes(spark, sf))


@query("role_questions", f"""
    WITH {RESOLVED}, {ROLES},
    sp AS (SELECT claim_id, bool_or(type = 'probe_result' AND NOT stale) AS probed, bool_or(type = 'declaration') AS refused FROM ev GROUP BY 1),
    pc AS (SELECT 'R' || cust AS role, status IN ('tested', 'business-confirmed') AS settled, coalesce(probed, false) AS probed,
      coalesce(refused, false) AS refused, 'column=y' || y || ', table=orders' AS opt FROM resolved LEFT JOIN sp ON claim_id = id),
    pr AS (SELECT role, count(*) AS n, bool_or(settled) AS settled, bool_or(probed) AS probed, bool_and(refused) AS refused,
      string_agg(DISTINCT opt, ' | ' ORDER BY opt) AS options FROM pc GROUP BY 1),
    q AS (SELECT role, coalesce(n, 0) AS n_candidates, CASE WHEN settled THEN NULL
      WHEN n IS NULL THEN 'Fachfrage: Für die Rolle ''' || role || ''' wurde kein Kandidat vorgeschlagen — gibt es diese Rolle in dieser Datenlandschaft?'
      WHEN decided_by = 'fachfrage' THEN 'Fachfrage: Die Rolle ''' || role || ''' kann keine Sonde entscheiden — welche Bindung gilt: ' || options || '?'
      WHEN probed THEN 'Fachfrage: Für die Rolle ''' || role || ''' hat keine vorgeschlagene Bindung ihre Invarianten-Sonde bestanden — welche Quelle ist führend?'
      WHEN refused THEN 'Fachfrage: Für die Rolle ''' || role || ''' konnte keine vorgeschlagene Bindung an ihre Invarianten-Sonde gebunden werden — welches Fachwissen fehlt?'
      END AS question FROM roles LEFT JOIN pr USING (role) WHERE decided_by <> 'slot')
    SELECT role, n_candidates, question FROM q WHERE question IS NOT NULL""")
def role_questions(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_roles(roles(spark, sf), candidates(spark, sf), evidence(spark, sf))


@query("role_options", f"""
    WITH {RESOLVED}, {ROLES},
    opts AS (SELECT 'R' || cust AS role, 'column=y' || y || ', table=orders' AS option, count(*) AS n_claims FROM resolved GROUP BY 1, 2)
    SELECT role, row_number() OVER (PARTITION BY role ORDER BY option) AS position, option, n_claims
    FROM opts WHERE role IN (SELECT role FROM roles WHERE decided_by = 'fachfrage')""")
def role_options(spark: SparkSession, sf: str) -> DataFrame:
    return R.role_options(roles(spark, sf), candidates(spark, sf))


@query("probe_templates", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {'NULL' if t.domain is None else chr(39) + t.domain + chr(39)})" for n, t in TEMPLATES.items()) +
    ") r(template, domain) WHERE template IN (SELECT " + case("event_type", TEMPLATE_OF) + " FROM events)")
def probe_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Registry entries that some probe uses."""
    return R.template_table(spark).join(probes(spark, sf), "template", "left_semi")
