"""Registered SPARQL queries over the mapped trade tables and the quad store, with their SQL oracles.

Each entry is (query text, oracle SQL); the text runs through parser, compiler and Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.engine import Engine
from quadloom.runtime import shared_folder, table
from quadloom.sources import quads
from quadloom.sources.mapped import warehouse
from quadloom.sources.quads import QuadSource



def iri(name: str, key: str) -> str:
    return f"'urn:t:{name}/' || CAST({key} AS VARCHAR)"


_REGIONS = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

#: Over the mapped tables.
WAREHOUSE: dict[str, tuple[str, str]] = {
    "bgp_star": (
        "SELECT ?o ?p ?s WHERE { ?o a t:Orders ; c:o_totalprice ?p ; c:o_orderstatus ?s }",
        f"SELECT {iri('orders', 'o_orderkey')} AS o, o_totalprice AS p, o_orderstatus AS s FROM orders",
    ),
    "bgp_chain": (
        "SELECT ?name ?price WHERE { ?o r:o_custkey ?c . ?c c:c_name ?name . ?o c:o_totalprice ?price FILTER(?price > 300000) }",
        "SELECT c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000",
    ),
    "bgp_snowflake": (
        "SELECT ?o ?cn ?nn ?rn WHERE { ?o r:o_custkey ?c . ?c c:c_name ?cn ; r:c_nationkey ?n . ?n c:n_name ?nn ; r:n_regionkey ?r . ?r c:r_name ?rn }",
        f"SELECT {iri('orders', 'o_orderkey')} AS o, c_name AS cn, n_name AS nn, r_name AS rn {_REGIONS}",
    ),
    "bgp_triangle": (
        "SELECT ?l ?n WHERE { ?l r:l_orderkey ?o ; r:l_suppkey ?s . ?o r:o_custkey ?c . ?c r:c_nationkey ?n . ?s r:s_nationkey ?n }",
        "SELECT 'urn:t:lineitem/' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l, "
        + iri("nation", "c_nationkey")
        + " AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
    ),
    "bgp_repeated_var": ("SELECT ?x WHERE { ?x r:self ?x }", f"SELECT {iri('events', 'event_id')} AS x FROM events WHERE user_id = event_id"),
    "bgp_cross": ("SELECT ?a ?b WHERE { ?x c:r_name ?a . ?y c:n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "bgp_sp_bound": ("SELECT ?v WHERE { <urn:t:customer/7> c:c_acctbal ?v }", "SELECT c_acctbal AS v FROM customer WHERE c_custkey = 7"),
    "bgp_po_bound": ("SELECT ?x WHERE { ?x c:c_mktsegment 'BUILDING' }", f"SELECT {iri('customer', 'c_custkey')} AS x FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "bgp_p_bound": ("SELECT ?x ?v WHERE { ?x c:event_type ?v }", f"SELECT {iri('events', 'event_id')} AS x, event_type AS v FROM events"),
    "bgp_p_range": ("SELECT ?x ?v WHERE { ?x c:value ?v FILTER(?v >= 10 && ?v < 20) }", f"SELECT {iri('events', 'event_id')} AS x, value AS v FROM events WHERE value >= 10 AND value < 20"),
    "bgp_full_scan": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { GRAPH <urn:g:customer> { ?s ?p ?o } } GROUP BY ?p",
        "SELECT p, count(*) AS n FROM (SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:c:c_custkey', 'urn:c:c_name', 'urn:c:c_nationkey', 'urn:c:c_acctbal', 'urn:c:c_mktsegment', 'urn:r:c_nationkey']) AS p FROM customer) GROUP BY p",
    ),
    "graph_var": (
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g",
        " UNION ALL ".join(f"SELECT 'urn:g:{t}' AS g, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "images")),
    ),
    "graph_const": ("SELECT ?s ?n WHERE { GRAPH <urn:g:supplier> { ?s c:s_name ?n } }", f"SELECT {iri('supplier', 's_suppkey')} AS s, s_name AS n FROM supplier"),
    "graph_var_join": (
        "SELECT ?g ?a ?b WHERE { GRAPH ?g { ?x c:n_name ?a ; r:n_regionkey ?r } ?r c:r_name ?b }",
        "SELECT 'urn:g:nation' AS g, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "from_named": (
        "SELECT ?g (COUNT(*) AS ?n) FROM NAMED g:orders FROM NAMED g:part WHERE { GRAPH ?g { ?s a ?t } } GROUP BY ?g",
        "SELECT 'urn:g:orders' AS g, count(*) AS n FROM orders UNION ALL SELECT 'urn:g:part', count(*) FROM part",
    ),
    "from_default": ("SELECT (COUNT(*) AS ?n) FROM g:orders FROM g:part WHERE { ?s a ?t }", "SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS n"),
    "filter_numeric": ("SELECT ?x WHERE { ?x c:p_retailprice ?v ; c:p_size ?z FILTER(?v > 910 && ?z * 2 <= 30) }", f"SELECT {iri('part', 'p_partkey')} AS x FROM part WHERE p_retailprice > 910 AND p_size * 2 <= 30"),
    "filter_range_pushdown": ("SELECT ?x ?v WHERE { ?x c:o_totalprice ?v FILTER(250000 < ?v) FILTER(?v <= 260000.5) }", f"SELECT {iri('orders', 'o_orderkey')} AS x, o_totalprice AS v FROM orders WHERE o_totalprice > 250000 AND o_totalprice <= 260000.5"),
    "filter_regex": ("SELECT ?x ?n WHERE { ?x c:p_name ?n FILTER(REGEX(?n, '^S.*G$', 'i')) }", f"SELECT {iri('part', 'p_partkey')} AS x, p_name AS n FROM part WHERE regexp_matches(p_name, '(?i)^S.*G$')"),
    "filter_logic": (
        "SELECT ?x WHERE { ?x a t:Documents ; c:n_chars ?n OPTIONAL { ?x c:fps ?f } FILTER(!(?f > 24) || ?n < 1000 && BOUND(?f)) }",
        f"SELECT {iri('documents', 'doc_id')} AS x FROM documents WHERE n_chars IS NOT NULL AND (NOT (fps > 24) OR (n_chars < 1000 AND fps IS NOT NULL))",
    ),
    "filter_in": ("SELECT ?x WHERE { ?x c:o_orderpriority ?p FILTER(?p IN ('1-URGENT', '2-HIGH')) }", f"SELECT {iri('orders', 'o_orderkey')} AS x FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_not_in": ("SELECT ?x WHERE { ?x c:p_type ?p FILTER(?p NOT IN ('SMALL', 'PROMO')) }", f"SELECT {iri('part', 'p_partkey')} AS x FROM part WHERE p_type NOT IN ('SMALL', 'PROMO')"),
    "coalesce_if": (
        "SELECT ?x (COALESCE(?l, 'none') AS ?lang) (IF(?n > 2000, 'long', 'short') AS ?size) WHERE { ?x a t:Documents OPTIONAL { ?x c:lang ?l } OPTIONAL { ?x c:n_chars ?n } }",
        f"SELECT {iri('documents', 'doc_id')} AS x, coalesce(lang, 'none') AS lang, CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars <= 2000 THEN 'short' END AS size FROM documents",
    ),
    "exists": ("SELECT ?c WHERE { ?c a t:Customer FILTER EXISTS { ?o r:o_custkey ?c ; c:o_orderstatus 'P' } }", f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "not_exists": ("SELECT ?d WHERE { ?d a t:Documents FILTER NOT EXISTS { ?d c:lang ?l } }", f"SELECT {iri('documents', 'doc_id')} AS d FROM documents WHERE lang IS NULL"),
    "exists_or": (
        "SELECT ?c WHERE { ?c c:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o r:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 450000) }) }",
        f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "exists_or_correlated": (
        "SELECT ?k WHERE { ?k c:c_acctbal ?b FILTER(?b > 9900 || EXISTS { ?o r:o_custkey ?k ; c:o_totalprice ?p FILTER(?p > ?b * 100) }) }",
        f"SELECT {iri('customer', 'c_custkey')} AS k FROM customer WHERE c_acctbal > 9900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 100)",
    ),
    "exists_deep": (
        "SELECT ?k WHERE { ?k c:c_acctbal ?b FILTER NOT EXISTS { { ?o r:o_custkey ?k ; c:o_totalprice ?p FILTER(?p > ?b * 50) } UNION { ?k c:c_mktsegment 'BUILDING' } } }",
        f"SELECT {iri('customer', 'c_custkey')} AS k FROM customer WHERE c_mktsegment <> 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)",
    ),
    "optional_exists": (
        "SELECT ?k ?o WHERE { ?k c:c_acctbal ?b OPTIONAL { ?o r:o_custkey ?k ; c:o_totalprice ?p FILTER(?p > 400000 || EXISTS { ?k c:c_mktsegment 'BUILDING' FILTER(?p < ?b) }) } }",
        f"SELECT {iri('customer', 'c_custkey')} AS k, CASE WHEN o_orderkey IS NOT NULL THEN {iri('orders', 'o_orderkey')} END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (o_totalprice > 400000 OR (c_mktsegment = 'BUILDING' AND o_totalprice < c_acctbal))",
    ),
    "optional_shared": (
        "SELECT ?d ?x ?l WHERE { ?d c:title_id ?t FILTER(?t = 1001) OPTIONAL { ?d c:lang ?l } OPTIONAL { ?x c:title_id ?u ; c:lang ?l FILTER(?u = 1003) } }",
        f"SELECT {iri('documents', 'd.doc_id')} AS d, {iri('documents', 'x.doc_id')} AS x, coalesce(d.lang, x.lang) AS l FROM documents d LEFT JOIN (SELECT * FROM documents WHERE title_id = 1003 AND lang IS NOT NULL) x ON d.lang = x.lang OR d.lang IS NULL WHERE d.title_id = 1001",
    ),
    "minus_unbound": (
        "SELECT ?d WHERE { ?d c:title_id ?t OPTIONAL { ?d c:lang ?l } MINUS { ?x c:title_id ?u ; c:lang ?l FILTER(?u = 1003) } }",
        f"SELECT {iri('documents', 'doc_id')} AS d FROM documents WHERE title_id IS NOT NULL AND (lang IS NULL OR lang NOT IN (SELECT lang FROM documents WHERE title_id = 1003 AND lang IS NOT NULL))",
    ),
    "sum_unbound": (
        "SELECT ?t (SUM(?f) AS ?s) (AVG(?f) AS ?a) WHERE { ?d a t:Documents ; c:title_id ?t OPTIONAL { ?d c:fps ?f } } GROUP BY ?t",
        "SELECT title_id AS t, CASE WHEN count(*) = count(fps) THEN sum(fps) END AS s, CASE WHEN count(*) = count(fps) THEN avg(fps) END AS a FROM documents WHERE title_id IS NOT NULL GROUP BY 1",
    ),
    "str_datetime": (
        "SELECT ?x (STR(?t) AS ?s) WHERE { ?x c:ts ?t }",
        f"SELECT {iri('events', 'event_id')} AS x, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '[.]?0+$', '') || 'Z' AS s FROM events",
    ),
    "project": ("SELECT ?n WHERE { ?x c:c_name ?n ; c:c_acctbal ?b }", "SELECT c_name AS n FROM customer"),
    "bind_expr": ("SELECT ?x ?v WHERE { ?x c:l_extendedprice ?p ; c:l_discount ?d BIND(?p * (1 - ?d) AS ?v) FILTER(?v > 90000) }", "SELECT 'urn:t:lineitem/' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS x, l_extendedprice * (1 - l_discount) AS v FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000"),
    "distinct": ("SELECT DISTINCT ?a ?b WHERE { ?x c:p_brand ?a ; c:p_type ?b }", "SELECT DISTINCT p_brand AS a, p_type AS b FROM part"),
    "join_groups": (
        "SELECT ?c ?a ?b WHERE { { SELECT ?c (COUNT(*) AS ?a) WHERE { ?o r:o_custkey ?c } GROUP BY ?c } { SELECT ?c (COUNT(*) AS ?b) WHERE { ?e r:user_id ?c } GROUP BY ?c } }",
        f"SELECT {iri('customer', 'k')} AS c, a, b FROM (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1) JOIN (SELECT user_id AS k, count(*) AS b FROM events GROUP BY 1) USING (k)",
    ),
    "optional": ("SELECT ?d ?l WHERE { ?d a t:Documents OPTIONAL { ?d c:lang ?l } }", f"SELECT {iri('documents', 'doc_id')} AS d, lang AS l FROM documents"),
    "optional_filter": ("SELECT ?d ?f WHERE { ?d a t:Documents OPTIONAL { ?d c:fps ?f FILTER(?f = 25) } }", f"SELECT {iri('documents', 'doc_id')} AS d, CASE WHEN fps = 25 THEN fps END AS f FROM documents"),
    "optional_nested": (
        "SELECT ?d ?l ?f WHERE { ?d a t:Documents OPTIONAL { ?d c:lang ?l OPTIONAL { ?d c:fps ?f } } }",
        f"SELECT {iri('documents', 'doc_id')} AS d, lang AS l, CASE WHEN lang IS NOT NULL THEN fps END AS f FROM documents",
    ),
    "optional_join": (
        "SELECT ?d ?l ?c WHERE { ?d a t:Documents OPTIONAL { ?d c:lang ?l } { SELECT ?l (COUNT(*) AS ?c) WHERE { ?x c:lang ?l } GROUP BY ?l HAVING(COUNT(*) > 150) } }",
        f"WITH n AS (SELECT lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) > 150) SELECT {iri('documents', 'doc_id')} AS d, n.lang AS l, c FROM documents d JOIN n ON d.lang = n.lang OR d.lang IS NULL",
    ),
    "minus": ("SELECT ?d WHERE { ?d a t:Documents MINUS { ?d c:lang 'en' } }", f"SELECT {iri('documents', 'doc_id')} AS d FROM documents WHERE lang IS DISTINCT FROM 'en'"),
    "minus_disjoint": ("SELECT ?n WHERE { ?x c:n_name ?n MINUS { ?y c:r_name ?m } }", "SELECT n_name AS n FROM nation"),
    "values_join": ("SELECT ?x ?s WHERE { ?x c:c_mktsegment ?s VALUES ?s { 'BUILDING' 'MACHINERY' } }", f"SELECT {iri('customer', 'c_custkey')} AS x, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "values_undef": (
        "SELECT ?x ?s ?t WHERE { ?x c:c_mktsegment ?s ; c:c_nationkey ?t VALUES (?s ?t) { ('BUILDING' UNDEF) (UNDEF '3'^^xsd:int) } }",
        f"SELECT {iri('customer', 'c_custkey')} AS x, c_mktsegment AS s, c_nationkey AS t FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {iri('customer', 'c_custkey')}, c_mktsegment, c_nationkey FROM customer WHERE c_nationkey = 3",
    ),
    "subquery_agg_join": (
        "SELECT ?n ?t WHERE { ?c c:c_name ?n . { SELECT ?c (ROUND(SUM(?p)) AS ?t) WHERE { ?o r:o_custkey ?c ; c:o_totalprice ?p } GROUP BY ?c } FILTER(?t > 3000000) }",
        "SELECT c_name AS n, t FROM customer JOIN (SELECT o_custkey, floor(sum(o_totalprice) + 0.5) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE t > 3000000",
    ),
    "theta_join": ("SELECT ?a ?b WHERE { ?x c:n_name ?a ; c:n_regionkey ?i . ?y c:r_name ?b ; c:r_regionkey ?j FILTER(?i < ?j) }", "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey < r_regionkey"),
    "group_count": ("SELECT ?f ?s (COUNT(*) AS ?n) WHERE { ?l c:l_returnflag ?f ; c:l_linestatus ?s } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "group_expr": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o c:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "agg_counts": (
        "SELECT ?s (COUNT(*) AS ?n) (COUNT(?l) AS ?m) (COUNT(DISTINCT ?l) AS ?k) WHERE { ?d a t:Documents ; c:title_id ?s OPTIONAL { ?d c:lang ?l } } GROUP BY ?s",
        "SELECT title_id AS s, count(*) AS n, count(lang) AS m, count(DISTINCT lang) AS k FROM documents WHERE title_id IS NOT NULL GROUP BY 1",
    ),
    "agg_sum_avg": (
        "SELECT ?f (SUM(?q) AS ?sq) (AVG(?q) AS ?aq) (xsd:double(ROUND(AVG(?n) * 1000)) AS ?an) WHERE { ?l c:l_returnflag ?f ; c:l_quantity ?q ; c:l_linenumber ?n } GROUP BY ?f",
        "SELECT l_returnflag AS f, sum(l_quantity) AS sq, avg(l_quantity) AS aq, floor(avg(l_linenumber) * 1000 + 0.5) AS an FROM lineitem GROUP BY 1",
    ),
    "agg_min_max": ("SELECT ?t (MIN(?v) AS ?lo) (MAX(?v) AS ?hi) (MAX(?d) AS ?last) WHERE { ?e c:event_type ?t ; c:value ?v ; c:ts ?d } GROUP BY ?t", "SELECT event_type AS t, min(value) AS lo, max(value) AS hi, max(ts) AS last FROM events GROUP BY 1"),
    "agg_sample": ("SELECT ?n (SAMPLE(?r) AS ?x) WHERE { ?k c:n_name ?n ; r:n_regionkey/c:r_name ?r } GROUP BY ?n", "SELECT n_name AS n, r_name AS x FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "agg_group_concat": (
        "SELECT ?r (GROUP_CONCAT(?n; SEPARATOR='|') AS ?l) WHERE { ?k c:n_name ?n ; r:n_regionkey/c:r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "having": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?o r:o_custkey ?c } GROUP BY ?c HAVING (COUNT(*) > 15)", f"SELECT {iri('customer', 'o_custkey')} AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "agg_empty": ("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?s) WHERE { ?x c:value ?v FILTER(?v < -1) }", "SELECT count(*) AS n, coalesce(sum(value), 0) AS s FROM events WHERE value < -1"),
    "order_by": ("SELECT ?x ?b WHERE { ?x c:s_acctbal ?b } ORDER BY DESC(?b) ?x", f"SELECT {iri('supplier', 's_suppkey')} AS x, s_acctbal AS b FROM supplier"),
    "limit_offset": ("SELECT ?k WHERE { ?x c:o_orderkey ?k } ORDER BY ?k OFFSET 20 LIMIT 20", "SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 20 OFFSET 20"),
    "topk": ("SELECT ?k ?p WHERE { ?x c:o_orderkey ?k ; c:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10"),
    "union": ("SELECT ?n WHERE { { ?x c:n_name ?n } UNION { ?x c:r_name ?n } }", "SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region"),
    "union_hetero": (
        "SELECT ?c ?s ?n WHERE { { ?c r:c_nationkey ?n } UNION { ?s r:s_nationkey ?n } }",
        f"SELECT {iri('customer', 'c_custkey')} AS c, NULL AS s, {iri('nation', 'c_nationkey')} AS n FROM customer UNION ALL SELECT NULL, {iri('supplier', 's_suppkey')}, {iri('nation', 's_nationkey')} FROM supplier",
    ),
    "ask_true": ("ASK { ?x c:o_orderstatus 'F' }", "SELECT true AS ask"),
    "ask_false": ("ASK { ?x c:o_orderstatus 'nowhere' }", "SELECT false AS ask"),
    "construct": (
        "CONSTRUCT { ?c <urn:k:in> ?r . ?r <urn:k:holds> ?c } WHERE { ?c r:c_nationkey/r:n_regionkey ?r }",
        "WITH x AS (SELECT '<urn:t:customer/' || c_custkey || '>' AS c, '<urn:t:region/' || n_regionkey || '>' AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c AS s, '<urn:k:in>' AS p, r AS o FROM x UNION SELECT r, '<urn:k:holds>', c FROM x",
    ),
    "describe": (
        "DESCRIBE ?n WHERE { ?n r:n_regionkey/c:r_name 'ASIA' }",
        """WITH x AS (SELECT n.* FROM nation n JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'), y AS (SELECT '<urn:t:nation/' || n_nationkey || '>' AS s, * FROM x)
        SELECT s, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' AS p, '<urn:t:Nation>' AS o FROM y UNION ALL SELECT s, '<urn:c:n_nationkey>', '"' || n_nationkey || '"^^xsd:int' FROM y
        UNION ALL SELECT s, '<urn:c:n_name>', '"' || n_name || '"^^xsd:string' FROM y UNION ALL SELECT s, '<urn:c:n_regionkey>', '"' || n_regionkey || '"^^xsd:int' FROM y
        UNION ALL SELECT s, '<urn:r:n_regionkey>', '<urn:t:region/' || n_regionkey || '>' FROM y UNION ALL SELECT s, '<urn:r:next>', '<urn:t:nation/' || ((n_nationkey + 1) % 25) || '>' FROM y""",
    ),
    "path_seq": ("SELECT ?o ?r WHERE { ?o r:o_custkey/r:c_nationkey/r:n_regionkey/c:r_name ?r }", f"SELECT {iri('orders', 'o_orderkey')} AS o, r_name AS r {_REGIONS}"),
    "path_alt": ("SELECT ?x ?n WHERE { ?x c:c_name|c:s_name ?n }", f"SELECT {iri('customer', 'c_custkey')} AS x, c_name AS n FROM customer UNION ALL SELECT {iri('supplier', 's_suppkey')}, s_name FROM supplier"),
    "path_inverse": ("SELECT ?n ?c WHERE { ?n ^r:c_nationkey ?c }", f"SELECT {iri('nation', 'c_nationkey')} AS n, {iri('customer', 'c_custkey')} AS c FROM customer"),
    "path_negated": (
        "SELECT (COUNT(*) AS ?n) WHERE { GRAPH g:nation { ?x !(rdf:type|c:n_name|r:next) ?y } }",
        "SELECT 3 * count(*) AS n FROM nation",
    ),
    "path_zero_or_one": (
        "SELECT ?x ?y WHERE { GRAPH g:nation { ?x r:next? ?y } FILTER(isIRI(?x) && CONTAINS(STR(?x), 'nation/')) }",
        "WITH n AS (SELECT '<urn:t:nation/' || n_nationkey || '>' AS x, '<urn:t:nation/' || ((n_nationkey + 1) % 25) || '>' AS y FROM nation) SELECT x, y FROM n UNION SELECT x, x FROM n",
    ),
    "path_plus": (
        "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x r:parent+ ?y } GROUP BY ?x",
        f"""WITH RECURSIVE up AS (SELECT event_id AS x, event_id // 2 AS y FROM events WHERE event_id > 0 UNION SELECT x, y // 2 FROM up WHERE y > 0)
        SELECT {iri('events', 'x')} AS x, count(DISTINCT y) AS n FROM up GROUP BY up.x""",
    ),
    "path_plus_cyclic": ("SELECT ?x ?y WHERE { ?x r:next+ ?y }", f"SELECT {iri('nation', 'a.n_nationkey')} AS x, {iri('nation', 'b.n_nationkey')} AS y FROM nation a, nation b"),
    "path_star": (
        "SELECT ?y WHERE { <urn:t:nation/3> r:next* ?y }",
        "SELECT '<urn:t:nation/' || n_nationkey || '>' AS y FROM nation",
    ),
    "fn_term": (
        "SELECT ?x (STR(?x) AS ?s) (DATATYPE(?k) AS ?d) (isIRI(?x) AS ?i) (isLiteral(?n) AS ?l) (isNumeric(?k) AS ?m) (isBlank(?x) AS ?b) (LANG(?n) AS ?g) WHERE { ?x c:n_name ?n ; c:n_nationkey ?k }",
        f"SELECT {iri('nation', 'n_nationkey')} AS x, {iri('nation', 'n_nationkey')} AS s, 'http://www.w3.org/2001/XMLSchema#int' AS d, true AS i, true AS l, true AS m, false AS b, '' AS g FROM nation",
    ),
    "fn_string": (
        """SELECT ?n (STRLEN(?n) AS ?a) (SUBSTR(?n, 2, 3) AS ?b) (UCASE(?n) AS ?u) (STRBEFORE(?n, ' ') AS ?d) (STRAFTER(?n, ' ') AS ?e) (CONCAT(?n, '-', ?t) AS ?f)
        (ENCODE_FOR_URI(?n) AS ?g) (STRSTARTS(?n, 's') AS ?h) (STRENDS(?n, 'g') AS ?i) (CONTAINS(?n, 'ed') AS ?j) (LCASE(?t) AS ?k) WHERE { ?x c:p_name ?n ; c:p_type ?t }""",
        """SELECT p_name AS n, length(p_name) AS a, substr(p_name, 2, 3) AS b, upper(p_name) AS u, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '' END AS d,
        CASE WHEN contains(p_name, ' ') THEN substr(p_name, position(' ' IN p_name) + 1) ELSE '' END AS e, p_name || '-' || p_type AS f, replace(p_name, ' ', '%20') AS g,
        starts_with(p_name, 's') AS h, ends_with(p_name, 'g') AS i, contains(p_name, 'ed') AS j, lower(p_type) AS k FROM part""",
    ),
    "fn_regex": ("SELECT ?n (REPLACE(?n, '[aeiou]+', '_') AS ?r) (REGEX(?n, 'ring') AS ?m) WHERE { ?x c:p_name ?n }", "SELECT p_name AS n, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS r, regexp_matches(p_name, 'ring') AS m FROM part"),
    "fn_numeric": (
        "SELECT ?b (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (?b / 4 AS ?d) (?k * 3 - 1 AS ?e) (-?b AS ?g) WHERE { ?x c:c_acctbal ?b ; c:c_custkey ?k }",
        "SELECT c_acctbal AS b, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, c_acctbal / 4 AS d, c_custkey * 3 - 1 AS e, -c_acctbal AS g FROM customer",
    ),
    "fn_datetime": (
        "SELECT ?x (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?i) (TZ(?t) AS ?z) WHERE { ?x c:ts ?t }",
        f"SELECT {iri('events', 'event_id')} AS x, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i, 'Z' AS z FROM events",
    ),
    "fn_hash": ("SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?x c:c_name ?n }", "SELECT c_name AS n, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer"),
    "fn_cast": (
        "SELECT ?k (xsd:string(?k) AS ?s) (xsd:double(?k) AS ?d) (xsd:integer(?p) AS ?i) (xsd:boolean(?z) AS ?b) (xsd:integer(?n) AS ?e) WHERE { ?x c:p_partkey ?k ; c:p_retailprice ?p ; c:p_size ?z ; c:p_name ?n }",
        "SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, CAST(p_partkey AS DOUBLE) AS d, CAST(trunc(p_retailprice) AS BIGINT) AS i, p_size <> 0 AS b, CAST(NULL AS BIGINT) AS e FROM part",
    ),
}


#: Over the quad store, patterns outside GRAPH seeing the union of all graphs.
STORE: dict[str, tuple[str, str]] = {
    "store_star": (
        "SELECT ?s ?k ?c WHERE { ?s <urn:x-graph:hal/type> ?k ; <urn:x-graph:hal/classification> ?c }",
        "WITH q AS (SELECT DISTINCT s, p, o FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND g IS NOT NULL) SELECT a.s, a.o AS k, b.o AS c FROM q a JOIN q b ON a.s = b.s WHERE a.p = '<urn:x-graph:hal/type>' AND b.p = '<urn:x-graph:hal/classification>'",
    ),
    "store_range": (
        "SELECT ?g ?s ?v WHERE { GRAPH ?g { ?s <urn:x-graph:pyr/Perimeter> ?v FILTER(?v >= 1000 && ?v < 1200) } }",
        "SELECT DISTINCT g, s, o AS v FROM quads WHERE p = '<urn:x-graph:pyr/Perimeter>' AND g <> '<urn:x-graph:default>' AND s IS NOT NULL AND o_dt IN ('xsd:double', 'xsd:float', 'xsd:decimal', 'xsd:integer', 'xsd:int', 'xsd:long') AND o_num >= 1000 AND o_num < 1200",
    ),
    "store_lang": (
        "SELECT (LANG(?l) AS ?g) (COUNT(*) AS ?n) WHERE { ?s <urn:x-graph:hal/label> ?l } GROUP BY (LANG(?l))",
        "WITH q AS (SELECT DISTINCT s, o, o_lang FROM quads WHERE p = '<urn:x-graph:hal/label>' AND s IS NOT NULL AND o IS NOT NULL AND g IS NOT NULL) SELECT coalesce(o_lang, '') AS g, count(*) AS n FROM q WHERE o LIKE '\"%' GROUP BY 1",
    ),
    "store_count_by_graph": (
        "SELECT ?g (COUNT(*) AS ?n) (COUNT(DISTINCT ?s) AS ?k) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g",
        "SELECT g, count(*) AS n, count(DISTINCT s) AS k FROM (SELECT DISTINCT g, s, p, o FROM quads WHERE g <> '<urn:x-graph:default>' AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) GROUP BY g",
    ),
}


def _on_warehouse(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(warehouse(spark, sf_dir)).sparql(text)


def _on_store(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(QuadSource(table(spark, sf_dir, "quads"), union_default=True)).sparql(text)


def store_set_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star over a written store, whose quads are unique: one shuffle of each side of the join."""
    path = shared_folder(spark, "set")
    quads.write(table(spark, sf_dir, "quads").select(*quads.KEY), path)
    return Engine.store(spark, path).sparql("SELECT ?g ?s ?k ?c WHERE { GRAPH ?g { ?s <urn:x-graph:hal/type> ?k ; <urn:x-graph:hal/classification> ?c } }")


QUERIES = {k: _on_warehouse(q) for k, (q, _) in WAREHOUSE.items()} | {k: _on_store(q) for k, (q, _) in STORE.items()} | {"store_set_star": store_set_star}
ORACLES = {k: sql for k, (_, sql) in (WAREHOUSE | STORE).items()}
ORACLES["store_set_star"] = """WITH q AS (SELECT DISTINCT g, s, p, o FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND g <> '<urn:x-graph:default>')
    SELECT a.g, a.s, a.o AS k, b.o AS c FROM q a JOIN q b ON a.s = b.s AND a.g = b.g WHERE a.p = '<urn:x-graph:hal/type>' AND b.p = '<urn:x-graph:hal/classification>'"""
