"""The registered queries over the driver's tables and the SQL that gives their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import NUMERIC, OWL, RDFS, TYPE, XSD, MappedTables, table_triples, triples, triples_sql
from .operators import algebra, graph, inference, learning, partition, rulesets, statistics
from .plans.fixpoint import closure, depths
from .plans import lake
from .plans.sparql import plain, query
from .sources import mapping, ntriples, tabular, writers

FLAGSHIP = "sparql_star_aggregate"
SMALL = ["region", "nation", "supplier"]
SALES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

#: name: (tables, SPARQL text, numeric variables, SQL over the same tables)
SPARQL = {
    "sparql_bgp_path": (["region", "nation", "customer"], "SELECT ?c ?r WHERE { ?c <urn:customer#c_nationkey>/<urn:nation#n_regionkey> ?g . ?g <urn:region#r_name> ?r }", (), "SELECT 'urn:customer:' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "sparql_star_aggregate": (["customer", "orders"], "SELECT ?seg (COUNT(?o) AS ?n) (MAX(?t) AS ?top) WHERE { ?o <urn:orders#o_custkey> ?c ; <urn:orders#o_totalprice> ?t . ?c <urn:customer#c_mktsegment> ?seg } GROUP BY ?seg", ("n", "top"), "SELECT c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS n, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "sparql_filter_regex": (["customer"], "SELECT ?c ?b WHERE { ?c <urn:customer#c_mktsegment> ?m ; <urn:customer#c_acctbal> ?b FILTER(REGEX(?m, '^build', 'i') && ?b > 5000) }", ("b",), "SELECT 'urn:customer:' || c_custkey AS c, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS b FROM customer WHERE c_mktsegment ILIKE 'build%' AND CAST(c_acctbal AS DECIMAL(18,2)) > 5000"),
    "sparql_optional": (["nation", "supplier"], "SELECT ?n ?s WHERE { ?n a <urn:class:nation> OPTIONAL { ?s <urn:supplier#s_nationkey> ?n ; <urn:supplier#s_acctbal> ?b FILTER(?b > 5000) } }", (), "SELECT 'urn:nation:' || n_nationkey AS n, 'urn:supplier:' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND CAST(s_acctbal AS DECIMAL(18,2)) > 5000"),
    "sparql_union_minus": (SMALL, "SELECT ?x WHERE { { ?x a <urn:class:region> } UNION { ?x a <urn:class:nation> } MINUS { ?s <urn:supplier#s_nationkey> ?x } }", (), "SELECT 'urn:region:' || r_regionkey AS x FROM region UNION ALL SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)"),
    "sparql_not_exists": (["customer", "orders"], "SELECT ?c WHERE { ?c a <urn:class:customer> FILTER NOT EXISTS { ?o <urn:orders#o_custkey> ?c } }", (), "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "sparql_subquery_having": (["customer", "orders"], "SELECT ?c ?n WHERE { { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o <urn:orders#o_custkey> ?c } GROUP BY ?c HAVING(COUNT(*) > 12) } ?c <urn:customer#c_mktsegment> 'BUILDING' }", ("n",), "SELECT 'urn:customer:' || c_custkey AS c, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey HAVING count(*) > 12"),
    "sparql_functions": (["nation"], "SELECT ?n (UCASE(SUBSTR(?v, 1, 3)) AS ?a) (STRLEN(?v) * 2 AS ?l) (STRAFTER(?v, '_') AS ?k) WHERE { ?n <urn:nation#n_name> ?v }", ("l",), "SELECT 'urn:nation:' || n_nationkey AS n, upper(substr(n_name, 1, 3)) AS a, CAST(length(n_name) * 2 AS DOUBLE) AS l, CASE WHEN instr(n_name, '_') = 0 THEN '' ELSE substr(n_name, instr(n_name, '_') + 1) END AS k FROM nation"),
    "sparql_values_bind": (["region"], "SELECT ?r ?w WHERE { VALUES ?v { 'ASIA' 'EUROPE' } ?r <urn:region#r_name> ?v BIND(CONCAT(LCASE(?v), '!') AS ?w) }", (), "SELECT 'urn:region:' || r_regionkey AS r, lower(r_name) || '!' AS w FROM region WHERE r_name IN ('ASIA', 'EUROPE')"),
    "sparql_top_k": (["orders"], "SELECT ?o ?t WHERE { ?o <urn:orders#o_totalprice> ?t } ORDER BY DESC(?t) ?o LIMIT 20", ("t",), "SELECT 'urn:orders:' || o_orderkey AS o, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS t FROM orders ORDER BY t DESC, o LIMIT 20"),
    "sparql_not_exists_rows": (["nation", "supplier"], "SELECT ?n WHERE { ?n a <urn:class:nation> FILTER NOT EXISTS { ?s <urn:supplier#s_nationkey> ?n ; <urn:supplier#s_acctbal> ?b FILTER(?b > 9000) } }", (), "SELECT 'urn:nation:' || n_nationkey AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND CAST(s_acctbal AS DECIMAL(18,2)) > 9000)"),
    "sparql_exists": (["customer", "orders"], "SELECT ?c WHERE { ?c a <urn:class:customer> FILTER EXISTS { ?o <urn:orders#o_custkey> ?c ; <urn:orders#o_orderpriority> '1-URGENT' } }", (), "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "sparql_exists_nested": (["nation", "supplier"], "SELECT ?n WHERE { ?n <urn:nation#n_name> ?v FILTER(?v < 'NATION_05' || EXISTS { ?s <urn:supplier#s_nationkey> ?n ; <urn:supplier#s_acctbal> ?b FILTER(?b > 9000) }) }", (), "SELECT 'urn:nation:' || n_nationkey AS n FROM nation WHERE n_name < 'NATION_05' OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND CAST(s_acctbal AS DECIMAL(18,2)) > 9000)"),
    "sparql_union": (SMALL, "SELECT ?x ?v WHERE { { ?x <urn:region#r_name> ?v } UNION { ?x <urn:nation#n_name> ?v } UNION { ?x <urn:supplier#s_name> ?v } }", (), "SELECT 'urn:region:' || r_regionkey AS x, r_name AS v FROM region UNION ALL SELECT 'urn:nation:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'urn:supplier:' || s_suppkey, s_name FROM supplier"),
    "sparql_distinct": (["customer"], "SELECT DISTINCT ?n ?m WHERE { ?c <urn:customer#c_nationkey> ?n ; <urn:customer#c_mktsegment> ?m }", (), "SELECT DISTINCT 'urn:nation:' || c_nationkey AS n, c_mktsegment AS m FROM customer"),
    "sparql_reduced": (["orders"], "SELECT REDUCED ?p WHERE { ?o <urn:orders#o_orderpriority> ?p }", (), "SELECT DISTINCT o_orderpriority AS p FROM orders"),
    "sparql_offset": (["orders"], "SELECT ?o ?t WHERE { ?o <urn:orders#o_totalprice> ?t } ORDER BY ?t ?o OFFSET 15 LIMIT 25", ("t",), "SELECT 'urn:orders:' || o_orderkey AS o, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS t FROM orders ORDER BY t, o LIMIT 25 OFFSET 15"),
    "sparql_avg_sum": (["orders"], "SELECT ?p (SUM(?t) AS ?s) (ROUND(AVG(?t) * 100) / 100 AS ?a) (MIN(?t) AS ?m) WHERE { ?o <urn:orders#o_orderpriority> ?p ; <urn:orders#o_totalprice> ?t } GROUP BY ?p", ("s", "a", "m"), "SELECT o_orderpriority AS p, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, floor(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100 + 0.5) / 100 AS a, CAST(min(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS m FROM orders GROUP BY 1"),
    "sparql_sum_integers": (["part"], "SELECT ?b (SUM(?z) AS ?s) (SUM(DISTINCT ?z) AS ?d) (COUNT(DISTINCT ?z) AS ?n) WHERE { ?p <urn:part#p_brand> ?b ; <urn:part#p_size> ?z } GROUP BY ?b", (), "SELECT p_brand AS b, CAST(sum(p_size) AS VARCHAR) AS s, CAST(sum(DISTINCT p_size) AS VARCHAR) AS d, CAST(count(DISTINCT p_size) AS VARCHAR) AS n FROM part GROUP BY 1"),
    "sparql_group_concat": (["nation"], "SELECT ?r (GROUP_CONCAT(DISTINCT ?v; SEPARATOR=',') AS ?all) WHERE { ?n <urn:nation#n_regionkey> ?r ; <urn:nation#n_name> ?v } GROUP BY ?r", (), "SELECT 'urn:region:' || n_regionkey AS r, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS \"all\" FROM nation GROUP BY n_regionkey"),
    "sparql_group_by_expression": (["customer"], "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c <urn:customer#c_mktsegment> ?m } GROUP BY (SUBSTR(?m, 1, 1) AS ?k)", ("n",), "SELECT substr(c_mktsegment, 1, 1) AS k, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1"),
    "sparql_comparisons": (["part"], "SELECT ?p ?z WHERE { ?p <urn:part#p_size> ?z FILTER((?z >= 10 && ?z <= 20 || ?z = 30) && ?z != 15 && !(?z < 12)) }", ("z",), "SELECT 'urn:part:' || p_partkey AS p, CAST(p_size AS DOUBLE) AS z FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_size = 30) AND p_size <> 15 AND NOT p_size < 12"),
    "sparql_arithmetic": (["part"], "SELECT ?p ((?z + 3) * 2 - 1 AS ?a) (?z / 4 AS ?q) WHERE { ?p <urn:part#p_size> ?z }", ("a", "q"), "SELECT 'urn:part:' || p_partkey AS p, CAST((p_size + 3) * 2 - 1 AS DOUBLE) AS a, p_size / 4.0::DOUBLE AS q FROM part"),
    "sparql_rounding": (["customer"], "SELECT ?c (ROUND(?b) AS ?r) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?d) (ABS(?b) AS ?a) WHERE { ?c <urn:customer#c_acctbal> ?b }", ("r", "u", "d", "a"), "SELECT 'urn:customer:' || c_custkey AS c, floor(b + 0.5) AS r, ceil(b) AS u, floor(b) AS d, abs(b) AS a FROM (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS b FROM customer)"),
    "sparql_strings": (["part"], "SELECT ?p (STRBEFORE(?n, ' ') AS ?f) (LCASE(?n) AS ?l) (REPLACE(?n, 'a', 'A') AS ?x) (ENCODE_FOR_URI(?n) AS ?u) WHERE { ?p <urn:part#p_name> ?n FILTER(CONTAINS(?n, 'e') && STRSTARTS(?n, SUBSTR(?n, 1, 1)) && STRENDS(?n, SUBSTR(?n, STRLEN(?n)))) }", (), "SELECT 'urn:part:' || p_partkey AS p, CASE WHEN instr(p_name, ' ') = 0 THEN '' ELSE substr(p_name, 1, instr(p_name, ' ') - 1) END AS f, lower(p_name) AS l, replace(p_name, 'a', 'A') AS x, url_encode(p_name) AS u FROM part WHERE contains(p_name, 'e')"),
    "sparql_hashes": (["nation"], "SELECT ?n (MD5(?v) AS ?a) (SHA1(?v) AS ?b) (SHA256(?v) AS ?c) WHERE { ?n <urn:nation#n_name> ?v }", (), "SELECT 'urn:nation:' || n_nationkey AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "sparql_terms": (["nation"], "SELECT ?n ?x (STR(DATATYPE(?x)) AS ?d) (isIRI(?x) AS ?i) (isLiteral(?x) AS ?l) (isBlank(?x) AS ?b) WHERE { ?n ?p ?x FILTER(?p != <http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) }", (), f"SELECT 'urn:nation:' || n_nationkey AS n, n_name AS x, '{XSD}string' AS d, 'false' AS i, 'true' AS l, 'false' AS b FROM nation UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey, NULL, 'true', 'false', 'false' FROM nation"),
    "sparql_conditions": (["supplier"], "SELECT ?s (IF(?b > 5000, 'high', 'low') AS ?k) (COALESCE(?none, ?v) AS ?c) (BOUND(?none) AS ?f) WHERE { ?s <urn:supplier#s_acctbal> ?b ; <urn:supplier#s_name> ?v }", (), "SELECT 'urn:supplier:' || s_suppkey AS s, CASE WHEN CAST(s_acctbal AS DECIMAL(18,2)) > 5000 THEN 'high' ELSE 'low' END AS k, s_name AS c, 'false' AS f FROM supplier"),
    "sparql_in_list": (["customer"], "SELECT ?c WHERE { ?c <urn:customer#c_mktsegment> ?m FILTER(?m IN ('BUILDING', 'MACHINERY') && ?m NOT IN ('MACHINERY')) }", (), "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "sparql_casts": (["part"], "SELECT ?p (xsd:integer(?z) AS ?i) (xsd:string(?z) AS ?s) (xsd:double(STR(?z)) * 2 AS ?d) WHERE { ?p <urn:part#p_size> ?z }", ("i", "d"), "SELECT 'urn:part:' || p_partkey AS p, CAST(p_size AS DOUBLE) AS i, CAST(p_size AS VARCHAR) AS s, p_size * 2.0::DOUBLE AS d FROM part"),
    "sparql_path_inverse": (SMALL, "SELECT ?r ?s WHERE { ?r ^<urn:nation#n_regionkey>/^<urn:supplier#s_nationkey> ?s }", (), "SELECT 'urn:region:' || n_regionkey AS r, 'urn:supplier:' || s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "sparql_path_alternative": (SMALL, "SELECT ?x ?y WHERE { ?x <urn:nation#n_regionkey>|<urn:supplier#s_nationkey> ?y }", (), "SELECT 'urn:nation:' || n_nationkey AS x, 'urn:region:' || n_regionkey AS y FROM nation UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier"),
    "sparql_path_plus": (SMALL, "SELECT ?x ?y WHERE { ?x (<urn:nation#n_regionkey>|<urn:supplier#s_nationkey>)+ ?y }", (), "SELECT 'urn:nation:' || n_nationkey AS x, 'urn:region:' || n_regionkey AS y FROM nation UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "sparql_path_not": (["nation"], "SELECT ?x ?y WHERE { ?x !(<urn:nation#n_name>|rdf:type) ?y }", (), "SELECT 'urn:nation:' || n_nationkey AS x, 'urn:region:' || n_regionkey AS y FROM nation"),
    "sparql_lateral": (["part"], "SELECT ?p ?y WHERE { ?p <urn:part#p_size> ?z LATERAL { BIND(?z * 2 AS ?y) FILTER(?y > 60) } }", ("y",), "SELECT 'urn:part:' || p_partkey AS p, p_size * 2.0::DOUBLE AS y FROM part WHERE p_size * 2 > 60"),
    "sparql_service_broadcast": (["nation", "customer"], "SELECT ?c ?v WHERE { ?c <urn:customer#c_nationkey> ?n SERVICE <urn:hint:broadcastJoin> { ?n <urn:nation#n_name> ?v } }", (), "SELECT 'urn:customer:' || c_custkey AS c, n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "sparql_values_undef": (["nation"], "SELECT ?n ?v WHERE { VALUES (?n ?v) { (<urn:nation:1> UNDEF) (UNDEF 'NATION_02') } ?n <urn:nation#n_name> ?v }", (), "SELECT 'urn:nation:' || n_nationkey AS n, n_name AS v FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'urn:nation:' || n_nationkey, n_name FROM nation WHERE n_name = 'NATION_02'"),
    "sparql_optional_join": (["nation", "supplier"], "SELECT ?n ?s ?v WHERE { ?n a <urn:class:nation> OPTIONAL { ?s <urn:supplier#s_nationkey> ?n } OPTIONAL { ?s <urn:supplier#s_name> ?v } FILTER(BOUND(?s)) }", (), "SELECT 'urn:nation:' || n_nationkey AS n, 'urn:supplier:' || s_suppkey AS s, s_name AS v FROM nation JOIN supplier ON s_nationkey = n_nationkey OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)"),
    "sparql_three_tables": (["customer", "orders", "lineitem", "nation"], "SELECT ?v (COUNT(?l) AS ?n) (SUM(?q) AS ?s) WHERE { ?l <urn:lineitem#l_orderkey> ?o ; <urn:lineitem#l_quantity> ?q ; <urn:lineitem#l_returnflag> 'R' . ?o <urn:orders#o_custkey> ?c . ?c <urn:customer#c_nationkey> ?x . ?x <urn:nation#n_name> ?v } GROUP BY ?v", ("n", "s"), "SELECT n_name AS v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY 1"),
    "sparql_distinct_count": (["orders"], "SELECT ?p (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o <urn:orders#o_orderpriority> ?p ; <urn:orders#o_custkey> ?c } GROUP BY ?p", ("n",), "SELECT o_orderpriority AS p, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS n FROM orders GROUP BY 1"),
}

NS = "regexp_extract({}, '^(.*[#/])[^#/]*$', 1)"
NUMBER = "dt IN (" + ", ".join(f"'{d}'" for d in NUMERIC) + ")"

#: name: (tables, function of the triples, SQL over a table t of triples)
OVER_TRIPLES: dict[str, tuple] = {
    "stats_used_classes": (SALES, statistics.used_classes, f"SELECT o AS class, count(*) AS n FROM t WHERE p = '{TYPE}' GROUP BY 1"),
    "stats_property_usage": (SALES, statistics.property_usage, "SELECT p AS property, count(*) AS n FROM t GROUP BY 1"),
    "stats_distinct_entities": (SALES, statistics.distinct_entities, "SELECT count(DISTINCT iri) AS entities, count(*) AS mentions FROM (SELECT s AS iri FROM t UNION ALL SELECT p FROM t UNION ALL SELECT o FROM t WHERE t = 1)"),
    "stats_datatypes": (SALES, statistics.datatypes, "SELECT dt, count(*) AS n FROM t WHERE t = 2 GROUP BY 1"),
    "stats_vocabularies": (SALES, lambda t: statistics.vocabularies(t, "p"), f"SELECT {NS.format('p')} AS ns, count(*) AS n FROM t GROUP BY 1"),
    "stats_properties_per_subject": (SALES, lambda t: statistics.properties_per(t, "s"), "SELECT s AS node, count(DISTINCT p) AS n FROM t GROUP BY 1"),
    "stats_properties_per_object": (SMALL, lambda t: statistics.properties_per(t, "o"), "SELECT o AS node, count(DISTINCT p) AS n FROM t GROUP BY 1"),
    "stats_value_per_property": (SALES, lambda t: statistics.value_per_property(t).withColumn("mean", F.round("mean", 4)), f"SELECT p AS property, max(CAST(o AS DOUBLE)) AS largest, round(avg(CAST(o AS DOUBLE)), 4) AS mean FROM t WHERE t = 2 AND {NUMBER} GROUP BY 1"),
    "stats_literal_counts": (SALES, lambda t: statistics.counts(t).select("triples", "distinct_subjects", "distinct_objects", "literals", "typed_subjects"), f"SELECT count(*) AS triples, count(DISTINCT s) AS distinct_subjects, count(DISTINCT CASE WHEN t = 1 THEN o END) AS distinct_objects, count(CASE WHEN t = 2 THEN 1 END) AS literals, count(CASE WHEN p = '{TYPE}' THEN 1 END) AS typed_subjects FROM t"),
    "quality_coverage": (SALES, lambda t: statistics.quality(t, "urn:").select("triples", F.round("coverage_detail", 12).alias("coverage_detail"), F.round("coverage_scope", 12).alias("coverage_scope"), "amount_of_triples"), f"SELECT count(*) AS triples, round(count(DISTINCT p) / count(*), 12) AS coverage_detail, round(count(DISTINCT CASE WHEN p = '{TYPE}' THEN s END) / count(*), 12) AS coverage_scope, CAST(CASE WHEN count(*) >= 1000000000 THEN 1 WHEN count(*) >= 10000000 THEN 0.75 WHEN count(*) >= 500000 THEN 0.5 WHEN count(*) >= 10000 THEN 0.25 ELSE 0 END AS DOUBLE) AS amount_of_triples FROM t"),
    "graph_find": (SALES, lambda t: graph.find(t, p="urn:orders#o_custkey").select("s", "o"), "SELECT s, o FROM t WHERE p = 'urn:orders#o_custkey'"),
    "graph_property_table": (["nation"], lambda t: graph.property_table(t, ["urn:nation#n_name"]).select("s", F.element_at("urn:nation#n_name", 1).alias("name")), "SELECT s, o AS name FROM t WHERE p = 'urn:nation#n_name'"),
    "graph_in_degree": (SALES, lambda t: t.where("t = 1").groupBy("o").agg(F.count("*").alias("n")), "SELECT o, count(*) AS n FROM t WHERE t = 1 GROUP BY 1"),
    "graph_outliers_zscore": (["customer", "supplier"], lambda t: graph.outliers(t, "zscore", 1.6), f"SELECT s, p, CAST(o AS DOUBLE) AS v FROM t JOIN (SELECT p AS q, avg(CAST(o AS DOUBLE)) AS m, stddev_pop(CAST(o AS DOUBLE)) AS d FROM t WHERE t = 2 AND {NUMBER} GROUP BY 1) ON p = q WHERE {NUMBER} AND abs(CAST(o AS DOUBLE) - m) > 1.6 * d"),
    "graph_jaccard_similarity": (["supplier"], lambda t: graph.similarity(graph.features(t.where("t = 1"), "os"), graph.features(t.where("t = 1"), "os"), "jaccard", 0.9).select("left", "right"), "SELECT a.s AS left, b.s AS right FROM t a JOIN t b ON a.p = b.p AND a.o = b.o AND a.s < b.s WHERE a.p = 'urn:supplier#s_nationkey'"),
    "stats_vocabularies_subjects": (SALES, lambda t: statistics.vocabularies(t, "s"), f"SELECT {NS.format('s')} AS ns, count(*) AS n FROM t GROUP BY 1"),
    "stats_vocabularies_objects": (SALES, lambda t: statistics.vocabularies(t, "o"), f"SELECT {NS.format('o')} AS ns, count(*) AS n FROM t WHERE t = 1 GROUP BY 1"),
    "stats_classes_defined": (SMALL, lambda t: statistics.classes_defined(t.unionByName(_classes(t))), "SELECT unnest(['urn:class:company', 'urn:class:agent']) AS class"),
    "stats_properties_defined": (SMALL, lambda t: statistics.properties_defined(t.unionByName(_classes(t))), "SELECT 'urn:supplier#s_name' AS property"),
    "stats_labels_links": (SMALL, lambda t: statistics.counts(t.unionByName(_classes(t))).select("labeled_subjects", "same_as", "subclass_usage", "blanks_as_subject", "blanks_as_object"), "SELECT CAST(1 AS BIGINT) AS labeled_subjects, CAST(1 AS BIGINT) AS same_as, CAST(1 AS BIGINT) AS subclass_usage, CAST(1 AS BIGINT) AS blanks_as_subject, CAST(1 AS BIGINT) AS blanks_as_object"),
    "stats_string_lengths": (SALES, lambda t: statistics.counts(t).select(F.round("avg_typed_string_length", 6).alias("typed")), f"SELECT round(avg(CASE WHEN t = 2 AND dt = '{XSD}string' THEN length(o) END), 6) AS typed FROM t"),
    "stats_languages": (["nation"], lambda t: statistics.languages(t.withColumn("lang", F.when(F.col("t") == 2, F.concat(F.lit("x-"), F.lower(F.substring("o", 1, 1)))))), "SELECT 'x-' || lower(substr(o, 1, 1)) AS lang, count(*) AS n FROM t WHERE t = 2 GROUP BY 1"),
    "stats_links": (["nation", "region"], lambda t: statistics.links(t.withColumns({"s": F.replace("s", F.lit("urn:"), F.lit("http://a/")), "o": F.replace("o", F.lit("urn:region"), F.lit("http://b/region"))}).where("p = 'urn:nation#n_regionkey'")), "SELECT 'http://a/' AS from_ns, 'http://b/' AS to_ns, count(*) AS n FROM t WHERE p = 'urn:nation#n_regionkey'"),
    "stats_property_hierarchy_depth": (SMALL, lambda t: statistics.hierarchy_depth(triples(t.sparkSession, [(f"urn:p{k}", RDFS + "subPropertyOf", f"urn:p{k + 1}") for k in range(4)]), RDFS + "subPropertyOf"), "SELECT 'urn:p' || k AS node, CAST(4 - k AS INTEGER) AS depth FROM range(5) r(k)"),
    "stats_description": (SALES, lambda t: statistics.describe(t).where("criterion in ('triples', 'classPartition', 'propertyPartition', 'datatype')"), f"SELECT 'triples' AS criterion, NULL AS key, count(*) AS n FROM t UNION ALL SELECT 'classPartition', o, count(*) FROM t WHERE p = '{TYPE}' GROUP BY o UNION ALL SELECT 'propertyPartition', p, count(*) FROM t GROUP BY p UNION ALL SELECT 'datatype', dt, count(*) FROM t WHERE t = 2 GROUP BY dt"),
    "stats_void_description": (SALES, lambda t: statistics.void_description(t, "urn:data").where("value like '%propertyPartition%'"), "SELECT '<urn:data> <http://rdfs.org/ns/void#propertyPartition> [ <http://rdfs.org/ns/void#property> <' || p || '> ; <http://rdfs.org/ns/void#triples> ' || count(*) || ' ] .' AS value FROM t GROUP BY p"),
    "quality_uris": (SALES, lambda t: statistics.quality(t, "urn:").select(F.round("hash_uris", 9).alias("hash_uris"), F.round("query_uris", 9).alias("query_uris"), F.round("short_uris", 9).alias("short_uris"), F.round("interlinking", 9).alias("interlinking")), "SELECT round((count(CASE WHEN contains(s, '#') THEN 1 END) + count(CASE WHEN contains(p, '#') THEN 1 END) + count(CASE WHEN t = 1 AND contains(o, '#') THEN 1 END)) / count(*), 9) AS hash_uris, round((count(CASE WHEN contains(s, '?') THEN 1 END) + count(CASE WHEN contains(p, '?') THEN 1 END)) / count(*), 9) AS query_uris, round((count(CASE WHEN length(s) < 95 THEN 1 END) + count(CASE WHEN length(p) < 95 THEN 1 END) + count(CASE WHEN t = 1 AND length(o) < 95 THEN 1 END)) / count(*), 9) AS short_uris, round(count(CASE WHEN t = 1 AND NOT starts_with(o, 'urn:') THEN 1 END) / count(*), 9) AS interlinking FROM t"),
    "quality_licences_labels": (SMALL, lambda t: statistics.quality(t.unionByName(_classes(t)), "urn:").select("machine_readable_license", "human_readable_license", F.round("external_same_as", 9).alias("external_same_as"), F.round("labeled_resources", 9).alias("labeled_resources")), "SELECT 0.0::DOUBLE AS machine_readable_license, 0.0::DOUBLE AS human_readable_license, round(1 / (count(*) + 7), 9) AS external_same_as, round(1 / (count(*) + 7), 9) AS labeled_resources FROM t"),
    "quality_conciseness": (["nation", "supplier"], lambda t: statistics.extensional_conciseness(t.where("p like '%nationkey' or p like '%regionkey'")), "SELECT sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n) AS extensional_conciseness FROM (SELECT p, o, count(*) AS n FROM t WHERE p LIKE '%nationkey' OR p LIKE '%regionkey' GROUP BY 1, 2)"),
    "quality_literals": (SALES, statistics.valid_literals, f"SELECT dt, CAST(count(CASE WHEN dt = '{XSD}string' OR regexp_full_match(o, '[+-]?[0-9]+([.][0-9]*)?') THEN 1 END) AS BIGINT) AS valid, CAST(count(CASE WHEN NOT (dt = '{XSD}string' OR regexp_full_match(o, '[+-]?[0-9]+([.][0-9]*)?')) THEN 1 END) AS BIGINT) AS wrong FROM (SELECT DISTINCT o, dt FROM t WHERE t = 2) GROUP BY dt"),
    "quality_numeric_range": (["customer"], lambda t: statistics.numeric_range(t, "urn:customer#c_acctbal", 0, 5000), "SELECT count(*) AS n, count(CASE WHEN CAST(o AS DOUBLE) > 0 AND CAST(o AS DOUBLE) < 5000 THEN 1 END) / count(*) AS share FROM t WHERE p = 'urn:customer#c_acctbal'"),
    "quality_property_completeness": (["nation", "supplier"], lambda t: statistics.property_completeness(t, "urn:class:supplier", "urn:supplier#s_nationkey"), "SELECT count(*) AS things, count(b.s) / count(*) AS share FROM (SELECT DISTINCT s FROM t WHERE o = 'urn:class:supplier') a LEFT JOIN (SELECT DISTINCT s FROM t WHERE p = 'urn:supplier#s_nationkey') b USING (s)"),
    "quality_schema_completeness": (SMALL, lambda t: statistics.schema_completeness(t.unionByName(_classes(t))), "SELECT CAST(3 AS BIGINT) AS declared, 1 / 3 AS share"),
    "graph_union": (["nation", "region"], lambda t: graph.union(t, t).select("s", "p", "o"), "SELECT DISTINCT s, p, o FROM t"),
    "graph_union_all": (["nation", "region"], lambda t: algebra.union_all(t, t.where("t = 1")).select("s", "p", "o"), "SELECT s, p, o FROM t UNION ALL SELECT s, p, o FROM t WHERE t = 1"),
    "graph_intersection": (["nation", "region"], lambda t: graph.intersection(t, t.where("t = 1")).select("s", "p", "o"), "SELECT DISTINCT s, p, o FROM t WHERE t = 1"),
    "graph_difference": (["nation", "region"], lambda t: graph.difference(t.unionByName(t), t.where("t = 1")).select("s", "p", "o"), "SELECT DISTINCT s, p, o FROM t WHERE t = 2"),
    "graph_remove": (["nation"], lambda t: algebra.remove(t.unionByName(t), [("urn:nation:1", "urn:nation#n_regionkey", "urn:region:1")]).select("s", "p", "o"), "SELECT s, p, o FROM t WHERE NOT (s = 'urn:nation:1' AND p = 'urn:nation#n_regionkey' AND o = 'urn:region:1') UNION ALL SELECT s, p, o FROM t WHERE NOT (s = 'urn:nation:1' AND p = 'urn:nation#n_regionkey' AND o = 'urn:region:1')"),
    "graph_add": (["region"], lambda t: algebra.add(t, [("urn:x", "urn:p", "urn:y")]).select("s", "p", "o"), "SELECT s, p, o FROM t UNION ALL SELECT 'urn:x', 'urn:p', 'urn:y'"),
    "graph_contains": (["nation", "region"], lambda t: _flags(t, any=algebra.contains_any(t, t.limit(1)), all=algebra.contains_all(t, t.where("t = 1")), not_all=algebra.contains_all(t.where("t = 1"), t), one=algebra.contains(t, o="urn:region:1")), "SELECT true AS \"any\", true AS \"all\", false AS not_all, true AS one"),
    "graph_subjects": (["nation"], algebra.subjects, "SELECT s FROM t"),
    "graph_predicates": (["nation"], algebra.predicates, "SELECT p FROM t"),
    "graph_objects": (["nation"], lambda t: algebra.objects(t).select("o", "dt"), "SELECT o, dt FROM t"),
    "graph_filter_subjects": (["nation"], lambda t: algebra.filter_place(t, "s", lambda c: c.endswith("1")).select("s", "p", "o"), "SELECT s, p, o FROM t WHERE s LIKE '%1'"),
    "graph_filter_predicates": (SALES, lambda t: algebra.filter_place(t, "p", {"urn:nation#n_name", "urn:region#r_name"}).select("s", "p", "o"), "SELECT s, p, o FROM t WHERE p IN ('urn:nation#n_name', 'urn:region#r_name')"),
    "graph_filter_objects": (["nation"], lambda t: algebra.filter_place(t, "o", lambda c: c.startswith("urn:")).select("s", "p", "o"), "SELECT s, p, o FROM t WHERE o LIKE 'urn:%'"),
    "graph_into_graph": (["region"], lambda t: algebra.into_graph(t, "urn:g").select("s", "p", "o", "g"), "SELECT s, p, o, 'urn:g' AS g FROM t"),
    "graph_records": (["customer"], lambda t: algebra.records(t, "p", 50).groupBy("key").agg(F.sum("n").alias("n")), "SELECT p AS key, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1"),
    "graph_kinds": (["nation", "region", "supplier"], rulesets.kinds_of_things, f"SELECT types, outgoing, incoming, count(*) AS n FROM (SELECT x, coalesce(string_agg(DISTINCT CASE WHEN k = 't' THEN v END, ' ' ORDER BY CASE WHEN k = 't' THEN v END), '') AS types, coalesce(string_agg(DISTINCT CASE WHEN k = 'o' THEN v END, ' ' ORDER BY CASE WHEN k = 'o' THEN v END), '') AS outgoing, coalesce(string_agg(DISTINCT CASE WHEN k = 'i' THEN v END, ' ' ORDER BY CASE WHEN k = 'i' THEN v END), '') AS incoming FROM (SELECT s AS x, 't' AS k, o AS v FROM t WHERE p = '{TYPE}' UNION ALL SELECT s, 'o', p FROM t WHERE p <> '{TYPE}' UNION ALL SELECT o, 'i', p FROM t WHERE p <> '{TYPE}' AND t = 1) GROUP BY x) GROUP BY 1, 2, 3"),
    "graph_vertical_partition": (["nation", "customer"], lambda t: _vertical(t), "SELECT s, o FROM t WHERE p = 'urn:customer#c_mktsegment'"),
    "graph_dictionary": (["nation", "region"], lambda t: graph.dictionary(t, "p").select("term", "n", "id"), "SELECT p AS term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p) - 1 AS id FROM t GROUP BY p"),
    "graph_encode_decode": (["nation", "region"], lambda t: partition.decode(*partition.encode(t)), "SELECT s, p, o FROM t"),
    "graph_tensor": (["nation", "supplier"], lambda t: _tensor(t), f"SELECT count(*) AS links, (SELECT count(DISTINCT x) FROM (SELECT s AS x FROM t WHERE t = 1 UNION ALL SELECT o FROM t WHERE t = 1)) AS entities, count(DISTINCT p) AS relations FROM t WHERE t = 1"),
    "graph_partition_measures": (["nation", "supplier"], lambda t: partition.measures(partition.by_subject(t, 1), 1), "SELECT 1.0::DOUBLE AS duplication, 1.0::DOUBLE AS balance, 1.0::DOUBLE AS efficiency"),
    "graph_partition_both": (["nation", "region"], lambda t: partition.by_both(t, 4).select("s", "p", "o").distinct(), "SELECT DISTINCT s, p, o FROM t"),
    "graph_partition_path": (SMALL, lambda t: partition.by_path(t, 1).select("s", "p", "o"), "SELECT s, p, o FROM t"),
    "graph_shortest_paths": (SMALL, lambda t: graph.shortest_paths(t.where("p like '%key'").select(F.col("s").alias("src"), F.col("o").alias("dst")), ["urn:region:0", "urn:region:1"]), "WITH e AS (SELECT s, o FROM t WHERE p LIKE '%key') SELECT 'urn:region:0' AS node, 'urn:region:0' AS landmark, 0 AS hops UNION ALL SELECT 'urn:region:1', 'urn:region:1', 0 UNION ALL SELECT s, o, 1 FROM e WHERE o IN ('urn:region:0', 'urn:region:1') UNION ALL SELECT a.s, b.o, 2 FROM e a JOIN e b ON a.o = b.s WHERE b.o IN ('urn:region:0', 'urn:region:1')"),
    "graph_pagerank": (["nation", "region"], lambda t: graph.pagerank(t.where("p like '%key'").select(F.col("s").alias("src"), F.col("o").alias("dst")), 3).withColumn("rank", F.round("rank", 9)), "WITH e AS (SELECT s, o FROM t WHERE p LIKE '%key') SELECT s AS node, round(0.15, 9) AS rank FROM e UNION ALL SELECT o, round(0.15 + 0.85 * count(*) * 0.15, 9) FROM e GROUP BY o"),
    "graph_outliers_iqr": (["supplier"], lambda t: graph.outliers(t, "iqr", 0.3), f"SELECT s, p, CAST(o AS DOUBLE) AS v FROM t JOIN (SELECT p AS q, quantile_cont(CAST(o AS DOUBLE), 0.25) AS a, quantile_cont(CAST(o AS DOUBLE), 0.75) AS b FROM t WHERE {NUMBER} GROUP BY 1) ON p = q WHERE {NUMBER} AND (CAST(o AS DOUBLE) < a - 0.3 * (b - a) OR CAST(o AS DOUBLE) > b + 0.3 * (b - a))"),
    "graph_outliers_mad": (["supplier"], lambda t: graph.outliers(t, "mad", 1.0), f"WITH r AS (SELECT s, p, CAST(o AS DOUBLE) AS v FROM t WHERE {NUMBER}), m AS (SELECT p AS q, median(v) AS mid FROM r GROUP BY 1), d AS (SELECT p AS q, mid, median(abs(v - mid)) AS mad FROM r JOIN m ON p = q GROUP BY 1, 2) SELECT s, p, v FROM r JOIN d ON p = q WHERE abs(v - mid) > 1.4826 * mad"),
    "features_modes": (["nation", "supplier"], lambda t: _modes(t), "SELECT mode, entity, count(DISTINCT f) AS n FROM (SELECT 'on' AS mode, s AS entity, o AS f FROM t UNION ALL SELECT 'or', s, p FROM t UNION ALL SELECT 'in', o, s FROM t WHERE t = 1 UNION ALL SELECT 'ir', o, p FROM t WHERE t = 1 UNION ALL SELECT 'os', s, p || ' ' || o FROM t UNION ALL SELECT 'is', o, p || ' ' || s FROM t WHERE t = 1 UNION ALL SELECT 'ar', s, p FROM t UNION ALL SELECT 'ar', o, p FROM t WHERE t = 1) GROUP BY 1, 2"),
    **{f"similarity_{m}": (["nation", "supplier"], (lambda m: lambda t: learning.similar(learning.features(t.where("t = 1"), "on"), measure=m, threshold=0.6).select("left", "right", F.round("value", 9).alias("value")))(m), f"WITH f AS (SELECT DISTINCT s AS e, o AS f FROM t WHERE t = 1), z AS (SELECT e, count(*) AS n FROM f GROUP BY 1), c AS (SELECT a.e AS l, b.e AS r, count(*) AS c FROM f a JOIN f b ON a.f = b.f AND a.e < b.e GROUP BY 1, 2) SELECT l AS \"left\", r AS \"right\", round({e}, 9) AS value FROM c JOIN z x ON x.e = l JOIN z y ON y.e = r WHERE {e} >= 0.6") for m, e in {"jaccard": "c / (x.n + y.n - c)", "dice": "2 * c / (x.n + y.n)", "simpson": "c / least(x.n, y.n)", "ochiai": "c / sqrt(x.n * y.n)", "braun_blanquet": "c / greatest(x.n, y.n)", "tversky": "c / (c + 0.5 * (x.n - c) + 0.5 * (y.n - c))"}.items()},
    "similarity_nearest": (["supplier"], lambda t: learning.nearest(learning.features(t.where("t = 1"), "on"), ["urn:nation:1", "urn:class:supplier"], 5).select("entity", F.round("value", 9).alias("value")), "WITH f AS (SELECT s AS e, count(DISTINCT o) AS n, count(DISTINCT CASE WHEN o IN ('urn:nation:1', 'urn:class:supplier') THEN o END) AS c FROM t WHERE t = 1 GROUP BY 1) SELECT e AS entity, round(c / (n + 2 - c), 9) AS value FROM f WHERE c > 0 ORDER BY c / (n + 2 - c) DESC, e LIMIT 5"),
    "anomaly_predicates": (["supplier"], lambda t: learning.predicate_anomalies(t.unionByName(triples(t.sparkSession, [("urn:supplier:1", "urn:odd", "urn:x")])), 0.5).select("s", "p"), "SELECT 'urn:supplier:1' AS s, 'urn:odd' AS p"),
    "features_pivot": (["supplier"], lambda t: learning.pivot_features(t, ["urn:supplier#s_acctbal", "urn:supplier#s_name"]).select("s", F.get("s_acctbal", F.lit(0)).alias("balance"), F.get("s_name", F.lit(0)).alias("name")), "SELECT s, max(CASE WHEN p = 'urn:supplier#s_acctbal' THEN CAST(o AS DOUBLE) END) AS balance, max(CASE WHEN p = 'urn:supplier#s_name' THEN o END) AS name FROM t WHERE p IN ('urn:supplier#s_acctbal', 'urn:supplier#s_name') GROUP BY s"),
    "features_frame": (["supplier"], lambda t: learning.sparql_frame(t, "SELECT ?n ?b WHERE { ?s <urn:supplier#s_nationkey> ?n ; <urn:supplier#s_acctbal> ?b }").groupBy("n").agg(F.max("b").alias("most")), "SELECT a.o AS n, max(CAST(b.o AS DOUBLE)) AS most FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'urn:supplier#s_nationkey' AND b.p = 'urn:supplier#s_acctbal' GROUP BY 1"),
    "lines_round_trip": (["nation", "region"], lambda t: ntriples.parse(t.select(ntriples.surface().alias("value"))).select("s", "p", "o", "dt"), "SELECT s, p, o, dt FROM t"),
    "documents_json": (["region"], lambda t: writers.lines(t, "rdfjson").select(F.get_json_object("value", "$").isNotNull().alias("ok")), "SELECT true AS ok FROM t"),
    "tables_tarql": (["nation"], lambda t: tabular.tarql(t.where("p = 'urn:nation#n_name'").select("s", "o"), "CONSTRUCT { ?x <urn:label> ?w } WHERE { BIND(IRI(?s) AS ?x) BIND(LCASE(?o) AS ?w) }").select("s", "p", "o"), "SELECT s, 'urn:label' AS p, lower(o) AS o FROM t WHERE p = 'urn:nation#n_name'"),
    "rules_owl_transitive": (SMALL, lambda t: _derived(t, [("urn:supplier#s_nationkey", RDFS + "subPropertyOf", "urn:in"), ("urn:nation#n_regionkey", RDFS + "subPropertyOf", "urn:in"), ("urn:in", TYPE, OWL + "TransitiveProperty")], "owl-horst", "p = 'urn:in'"), "WITH e AS (SELECT s, o FROM t WHERE p IN ('urn:supplier#s_nationkey', 'urn:nation#n_regionkey')) SELECT s, o FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s"),
    "rules_owl_inverse_symmetric": (SMALL, lambda t: _derived(t, [("urn:supplier#s_nationkey", OWL + "inverseOf", "urn:has"), ("urn:nation#n_regionkey", TYPE, OWL + "SymmetricProperty")], "owl-rl", "p = 'urn:has' or p = 'urn:nation#n_regionkey'"), "SELECT o AS s, s AS o FROM t WHERE p = 'urn:supplier#s_nationkey' UNION SELECT s, o FROM t WHERE p = 'urn:nation#n_regionkey' UNION SELECT o, s FROM t WHERE p = 'urn:nation#n_regionkey'"),
    "rules_owl_restrictions": (SMALL, lambda t: _derived(t, [("urn:R", OWL + "onProperty", "urn:nation#n_regionkey"), ("urn:R", OWL + "hasValue", "urn:region:1"), ("urn:S", OWL + "onProperty", "urn:supplier#s_nationkey"), ("urn:S", OWL + "someValuesFrom", "urn:R")], "owl-rl", "p = '%s' and o in ('urn:R', 'urn:S')" % TYPE), "SELECT s, 'urn:R' AS o FROM t WHERE p = 'urn:nation#n_regionkey' AND o = 'urn:region:1' UNION SELECT s, 'urn:S' FROM t WHERE p = 'urn:supplier#s_nationkey' AND o IN (SELECT s FROM t WHERE p = 'urn:nation#n_regionkey' AND o = 'urn:region:1')"),
    "rules_owl_functional": (["nation"], lambda t: _derived(t.where("p = 'urn:nation#n_regionkey'").select(F.col("o").alias("s"), F.lit("urn:of").alias("p"), F.col("s").alias("o"), "t", "dt", "lang").where("s = 'urn:region:1'"), [("urn:of", TYPE, OWL + "FunctionalProperty")], "owl-horst", "p = '%s' and s <> o" % (OWL + "sameAs")), "SELECT a.s, b.s AS o FROM t a JOIN t b ON a.p = b.p AND a.o = b.o AND a.s <> b.s WHERE a.p = 'urn:nation#n_regionkey' AND a.o = 'urn:region:1'"),
    "rules_owl_violations": (SMALL, lambda t: rulesets.violations(t.unionByName(triples(t.sparkSession, [("urn:class:nation", OWL + "disjointWith", "urn:class:region"), ("urn:nation:1", TYPE, "urn:class:region")]))), "SELECT 'urn:nation:1' AS thing, 'cax-dw' AS rule"),
    "rules_backward_types": (SMALL, lambda t: rulesets.ask_backward(t.unionByName(_ontology(t)), p=TYPE, o="urn:class:agent").select("s"), "SELECT DISTINCT s FROM t WHERE p = 'urn:supplier#s_nationkey'"),
    "rules_el": (SMALL, lambda t: rulesets.el(triples(t.sparkSession, [("urn:A", RDFS + "subClassOf", "urn:B"), ("urn:B", RDFS + "subClassOf", "_:r"), ("_:r", OWL + "onProperty", "urn:p"), ("_:r", OWL + "someValuesFrom", "urn:D"), ("urn:D", RDFS + "subClassOf", "urn:E"), ("_:s", OWL + "onProperty", "urn:p"), ("_:s", OWL + "someValuesFrom", "urn:E"), ("_:s", RDFS + "subClassOf", "urn:F")])), "SELECT * FROM (VALUES ('urn:A', 'urn:B'), ('urn:D', 'urn:E'), ('urn:A', 'urn:F'), ('urn:B', 'urn:F')) v(a, b)"),
    "inference_rdfs_range": (SMALL, lambda t: inference.rdfs(t.unionByName(triples(t.sparkSession, [("urn:supplier#s_nationkey", RDFS + "range", "urn:class:place")]))).where((F.col("p") == TYPE) & (F.col("o") == "urn:class:place")).select("s"), "SELECT DISTINCT o AS s FROM t WHERE p = 'urn:supplier#s_nationkey'"),
    "inference_rdfs_types": (SMALL, lambda t: inference.rdfs(t.unionByName(_ontology(t))).where((F.col("p") == TYPE) & F.col("s").startswith("urn:supplier:")).select("s", "o"), "SELECT s, x.o FROM (SELECT DISTINCT s FROM t WHERE s LIKE 'urn:supplier:%'), (VALUES ('urn:class:supplier'), ('urn:class:company'), ('urn:class:agent')) x(o)"),
}


def _ontology(t: DataFrame) -> DataFrame:
    rows = [("urn:class:supplier", RDFS + "subClassOf", "urn:class:company"), ("urn:class:company", RDFS + "subClassOf", "urn:class:agent"), ("urn:supplier#s_nationkey", RDFS + "domain", "urn:class:company")]
    return triples(t.sparkSession, rows)


def _classes(t: DataFrame) -> DataFrame:
    rows = [("urn:class:company", TYPE, OWL + "Class"), ("urn:class:agent", TYPE, RDFS + "Class"), ("urn:supplier#s_name", TYPE, OWL + "DatatypeProperty"), ("urn:class:company", RDFS + "subClassOf", "urn:class:agent"), ("urn:nation:1", OWL + "sameAs", "http://x/n1"), ("urn:class:agent", RDFS + "label", "agent", 2, XSD + "string"), ("_:b", "urn:p", "_:c", 0)]
    return triples(t.sparkSession, rows)


def _flags(t: DataFrame, **values: bool) -> DataFrame:
    return t.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def _vertical(t: DataFrame) -> DataFrame:
    return t.sparkSession.table(partition.register_vertical(t)["urn:customer#c_mktsegment"]).select("s", "o")


def _tensor(t: DataFrame) -> DataFrame:
    links, entities, relations = partition.tensor(t)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(links, "links").crossJoin(count(entities, "entities")).crossJoin(count(relations, "relations"))


def _modes(t: DataFrame) -> DataFrame:
    parts = [learning.features(t, m).select(F.lit(m).alias("mode"), "entity", F.size("features").cast("long").alias("n")) for m in ("on", "or", "in", "ir", "os", "is", "ar")]
    return algebra.union_all(*parts)


def _derived(t: DataFrame, ontology: list[tuple], rules: str, where: str) -> DataFrame:
    return rulesets.reason(t.unionByName(triples(t.sparkSession, ontology)), rules).where(where).select("s", "o").distinct()


def _sparql(tables, text, numbers):
    return lambda spark, sf_dir: plain(query(MappedTables(spark, sf_dir, tables), text), numbers)


def _over(tables, fn):
    return lambda spark, sf_dir: fn(table_triples(spark, sf_dir, tables))


def part_size_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitive closure of a chain of brands in order, a fixpoint over data."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("a")).distinct()
    later = brands.select(F.col("a").alias("c"))
    chain = brands.join(later, F.col("a") < F.col("c")).groupBy("a").agg(F.min("c").alias("b"))
    return closure(chain)


def brand_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("child")).distinct()
    later = brands.select(F.col("child").alias("c"))
    return depths(brands.join(later, F.col("child") < F.col("c")).groupBy("child").agg(F.min("c").alias("parent")))


#: RML over the tables of the folder: customers of nations, with a join to nations by key.
LAKE = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix v: <urn:v:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
<#C> rml:logicalSource [ rml:source "customer.parquet" ] ; rr:subjectMap [ rr:template "urn:customer:{c_custkey}"; rr:class v:Customer ] ;
  rr:predicateObjectMap [ rr:predicate v:segment; rr:objectMap [ rml:reference "c_mktsegment" ] ] ; rr:predicateObjectMap [ rr:predicate v:balance; rr:objectMap [ rml:reference "c_acctbal"; rr:datatype xsd:double ] ] ;
  rr:predicateObjectMap [ rr:predicate v:nation; rr:objectMap [ rr:parentTriplesMap <#N>; rr:joinCondition [ rr:child "c_nationkey"; rr:parent "n_nationkey" ] ] ] .
<#S> rml:logicalSource [ rml:source "supplier.parquet" ] ; rr:subjectMap [ rr:template "urn:supplier:{s_suppkey}"; rr:class v:Supplier ] ;
  rr:predicateObjectMap [ rr:predicate v:balance; rr:objectMap [ rml:reference "s_acctbal"; rr:datatype xsd:double ] ] ;
  rr:predicateObjectMap [ rr:predicate v:nation; rr:objectMap [ rr:template "urn:nation:{s_nationkey}" ] ] .
<#N> rml:logicalSource [ rml:source "nation.parquet" ] ; rr:subjectMap [ rr:template "urn:nation:{n_nationkey}"; rr:class v:Nation ] ;
  rr:predicateObjectMap [ rr:predicate v:name; rr:objectMap [ rml:reference "n_name" ] ] .
"""
#: name: (SPARQL over the mapped tables, numeric variables, SQL)
LAKE_QUERIES = {
    "lake_star_join": ("SELECT ?c ?v WHERE { ?c <urn:v:segment> 'BUILDING' ; <urn:v:nation> ?n . ?n <urn:v:name> ?v }", (), "SELECT 'urn:customer:' || c_custkey AS c, n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "lake_two_sources": ("SELECT ?x ?n WHERE { ?x <urn:v:balance> ?b ; <urn:v:nation> ?n FILTER(?b > 9000) }", (), "SELECT 'urn:customer:' || c_custkey AS x, 'urn:nation:' || c_nationkey AS n FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier WHERE s_acctbal > 9000"),
    "lake_group_order": ("SELECT ?m (COUNT(*) AS ?n) WHERE { ?c a <urn:v:Customer> ; <urn:v:segment> ?m } GROUP BY ?m ORDER BY DESC(?n) ?m LIMIT 3", ("n",), "SELECT c_mktsegment AS m, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1 ORDER BY n DESC, m LIMIT 3"),
    "lake_distinct": ("SELECT DISTINCT ?v WHERE { ?s a <urn:v:Supplier> ; <urn:v:nation> ?n . ?n <urn:v:name> ?v }", (), "SELECT DISTINCT n_name AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
}


def _lake(text: str, numbers: tuple[str, ...]):
    return lambda spark, sf_dir: plain(lake.answer(spark, text, LAKE, sf_dir), numbers)


def lake_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star decomposition, sources and join edges of a query."""
    p = lake.plan(LAKE_QUERIES["lake_star_join"][0], mapping.MappedSources(spark, LAKE, sf_dir), {"#N": 2.0})
    rows = [(s, ",".join(sorted(p.sources[s])), ",".join(sorted(p.needed[s])), p.order.index(s)) for s in p.stars]
    return spark.createDataFrame(rows, "star string, sources string, needed string, place int")


def lake_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.triples(spark, LAKE, sf_dir).groupBy("p").agg(F.count("*").alias("n"))


def lake_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(lake.transform(F.col("n_name"), ["skp(7)", "toInt"]).alias("a"), lake.transform(F.col("n_name"), ["replc(NATION, N)", "prefix(x)", "postfix(y)"]).alias("b"), lake.transform(F.col("n_nationkey"), ["scl(0.5)"]).alias("c"))


def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(MappedTables(spark, sf_dir, ["nation"]), "CONSTRUCT { ?r <urn:has> ?n } WHERE { ?n <urn:nation#n_regionkey> ?r }").select("s", "p", "o")


def construct_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(MappedTables(spark, sf_dir, ["nation"]), "CONSTRUCT { GRAPH ?r { ?n <urn:name> ?v } } WHERE { ?n <urn:nation#n_regionkey> ?r ; <urn:nation#n_name> ?v }").select("s", "p", "o", "g")


def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(MappedTables(spark, sf_dir, ["nation"]), "ASK { ?n <urn:nation#n_name> 'NATION_01' }")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table_triples(spark, sf_dir, ["nation"]), "DESCRIBE <urn:nation:3>").select("s", "p", "o")


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of nations, each in the graph of its region."""
    t = table_triples(spark, sf_dir, ["nation"])
    region = t.where("p = 'urn:nation#n_regionkey'").select(F.col("s").alias("of"), F.col("o").alias("g"))
    return t.join(region, F.col("s") == F.col("of")).drop("of")


def graph_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(query(_quads(spark, sf_dir), "SELECT ?g ?n WHERE { GRAPH ?g { ?x <urn:nation#n_name> ?n } }"))


def from_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(query(_quads(spark, sf_dir), "SELECT ?n FROM <urn:region:1> FROM <urn:region:2> WHERE { ?x <urn:nation#n_name> ?n }"))


def each_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = algebra.each_graph(_quads(spark, sf_dir), "SELECT (COUNT(?x) AS ?n) (MIN(?v) AS ?first) WHERE { ?x <urn:nation#n_name> ?v }")
    return got.select("g", F.col("n.v").cast("double").alias("n"), F.col("first.v").alias("first"))


def graphs_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.graphs_where(_quads(spark, sf_dir), "ASK { ?x <urn:nation#n_name> 'NATION_03' }").select("s", "p", "o", "g")


#: name: (function, SQL)
OTHERS = {
    "lake_plan": (lake_plan, "SELECT * FROM (VALUES ('c', '#C', 'urn:v:nation,urn:v:segment', 1), ('n', '#N', 'urn:v:name', 0)) v(star, sources, needed, place)"),
    "lake_triples": (lake_triples, f"SELECT '{TYPE}' AS p, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'urn:v:segment', count(c_mktsegment) FROM customer UNION ALL SELECT 'urn:v:balance', (SELECT count(c_acctbal) FROM customer) + (SELECT count(s_acctbal) FROM supplier) UNION ALL SELECT 'urn:v:nation', (SELECT count(c_nationkey) FROM customer) + (SELECT count(s_nationkey) FROM supplier) UNION ALL SELECT 'urn:v:name', count(n_name) FROM nation"),
    "lake_transform": (lake_transform, "SELECT CAST(substr(n_name, 8) AS BIGINT) AS a, 'x' || replace(n_name, 'NATION', 'N') || 'y' AS b, n_nationkey * 0.5::DOUBLE AS c FROM nation"),
    "sparql_construct": (construct, "SELECT 'urn:region:' || n_regionkey AS s, 'urn:has' AS p, 'urn:nation:' || n_nationkey AS o FROM nation"),
    "sparql_construct_quads": (construct_quads, "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:name' AS p, n_name AS o, 'urn:region:' || n_regionkey AS g FROM nation"),
    "sparql_ask": (ask, "SELECT count(*) > 0 AS answer FROM nation WHERE n_name = 'NATION_01'"),
    "sparql_describe": (describe, f"WITH t AS ({triples_sql(['nation'])}) SELECT s, p, o FROM t WHERE s = 'urn:nation:3'"),
    "sparql_graph": (graph_pattern, "SELECT 'urn:region:' || n_regionkey AS g, n_name AS n FROM nation"),
    "sparql_from": (from_graphs, "SELECT n_name AS n FROM nation WHERE n_regionkey IN (1, 2)"),
    "graphs_select_each": (each_graph, "SELECT 'urn:region:' || n_regionkey AS g, CAST(count(*) AS DOUBLE) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey"),
    "graphs_where": (graphs_where, f"WITH t AS ({triples_sql(['nation'])}), r AS (SELECT s AS k, o AS g FROM t WHERE p = 'urn:nation#n_regionkey') SELECT s, p, o, g FROM t JOIN r ON s = k WHERE g IN (SELECT g FROM r JOIN t ON s = k WHERE p = 'urn:nation#n_name' AND o = 'NATION_03')"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _sparql(tables, text, numbers) for name, (tables, text, numbers, _) in SPARQL.items()}
    out |= {name: _over(tables, fn) for name, (tables, fn, _) in OVER_TRIPLES.items()}
    out |= {name: _lake(text, numbers) for name, (text, numbers, _) in LAKE_QUERIES.items()}
    out |= {name: fn for name, (fn, _) in OTHERS.items()}
    return out | {"closure_brands": part_size_closure, "hierarchy_depth_brands": brand_depth}


def oracle_sql() -> dict[str, str]:
    out = {name: sql for name, (_, _, _, sql) in SPARQL.items()}
    out |= {name: f"WITH t AS ({triples_sql(tables)})" + (f", {sql[5:]}" if sql.startswith("WITH ") else f" {sql}") for name, (tables, _, sql) in OVER_TRIPLES.items()}
    out |= {name: sql for name, (_, _, sql) in LAKE_QUERIES.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
    return out | {
        "closure_brands": "WITH b AS (SELECT DISTINCT p_brand AS x FROM part) SELECT a.x AS a, b.x AS b FROM b a JOIN b ON a.x < b.x",
        "hierarchy_depth_brands": "WITH b AS (SELECT DISTINCT p_brand AS x FROM part) SELECT x AS node, CAST(row_number() OVER (ORDER BY x DESC) - 1 AS INTEGER) AS depth FROM b",
    }
