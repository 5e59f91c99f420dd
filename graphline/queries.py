"""The graph queries over whole tables: (spark, sf_dir) -> DataFrame, and their SQL.

Each runs one operator on a graph that is derived from the tables. The SQL is
written against the tables, not against what the operator builds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphline.functions import labels
from graphline.model import PropertyGraph
from graphline.operators import centrality, condense, cover, quality, reach, structure
from graphline.operators.explore import explore
from graphline.operators.search import LabelIndex
from graphline.sources.derived import GRAPHS

TARGET_LIMIT = 20
SAMPLE = 100
RANKS = 10


def graph(name: str, spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return GRAPHS[name](spark, sf_dir)


def _prefixed(g: PropertyGraph, table: str) -> DataFrame:
    return g.nodes.where(F.col("node_id").startswith(table + ":")).select("node_id")


def _nation_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of nation 0 as targets."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey = 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node_id"))


def graph_counts(spark, sf_dir):
    return graph("parts", spark, sf_dir).counts()


def degree_all(spark, sf_dir):
    return graph("parts", spark, sf_dir).degrees().select("node_id", "degree")


def in_degree(spark, sf_dir):
    return graph("parts", spark, sf_dir).degrees().select("node_id", "in_degree")


def out_degree(spark, sf_dir):
    return graph("supplies", spark, sf_dir).degrees().select("node_id", "out_degree")


def nodes_per_program(spark, sf_dir):
    return graph("supplies", spark, sf_dir).per_program()


def nodes_per_layer(spark, sf_dir):
    return graph("layered", spark, sf_dir).per_layer()


def programs(spark, sf_dir):
    return graph("layered", spark, sf_dir).programs()


def top_degree(spark, sf_dir):
    return structure.top_degree(graph("supplies", spark, sf_dir), RANKS).select("node_id", "degree")


def balanced_topk(spark, sf_dir):
    """The best-connected parts of each brand up to the quota for 100."""
    g = graph("supplies", spark, sf_dir)
    return structure.balanced_sample(PropertyGraph(g.nodes.where(F.col("node_id").startswith("part:")), g.edges), SAMPLE)


def balanced_topk_all(spark, sf_dir):
    """The best-connected suppliers and parts, each program up to the quota for 100."""
    return structure.balanced_sample(graph("supplies", spark, sf_dir), SAMPLE)


def neighbors_out(spark, sf_dir):
    return graph("parts", spark, sf_dir).neighbors("part:1", "out")


def neighbors_in(spark, sf_dir):
    return graph("parts", spark, sf_dir).neighbors("part:1", "in")


def khop_inbound(spark, sf_dir):
    return reach.k_hop_inbound(graph("parts", spark, sf_dir), "part:1", 2)[0]


def induced_edges(spark, sf_dir):
    return reach.k_hop_inbound(graph("parts", spark, sf_dir), "part:1", 1)[1].edges.select("src", "dst")


def shortest_path_len(spark, sf_dir):
    return reach.distances(graph("parts", spark, sf_dir), "part:1")


def shortest_path(spark, sf_dir):
    return reach.shortest_path(graph("parts", spark, sf_dir), "part:1", "part:2").select("hops", F.size("path").alias("nodes"))


def inbound_paths(spark, sf_dir):
    return reach.inbound_paths(graph("layered", spark, sf_dir), "supplier:1", 3).select("node_id", "hops")


def ancestors(spark, sf_dir):
    """The parts that lead to parts 0 to 19."""
    g = graph("parts", spark, sf_dir)
    targets = g.nodes.where(F.col("node_id").isin([f"part:{k}" for k in range(TARGET_LIMIT)]))
    return reach.ancestors(g, targets, depths=False)


def ancestors_suppliers(spark, sf_dir):
    """What leads to each supplier, over the tiers of orders."""
    g = graph("layered", spark, sf_dir)
    return reach.ancestors(g, _prefixed(g, "supplier"), depths=False)


def descendants(spark, sf_dir):
    g = graph("layered", spark, sf_dir)
    return reach.descendants(g, _prefixed(g, "region"), depths=False).where(F.col("node").startswith("supplier:"))


def reach_all_pairs(spark, sf_dir):
    g = graph("tiers", spark, sf_dir)
    return reach.ancestors(g, g.nodes).select("node", "target", "depth")


def has_path(spark, sf_dir):
    g = graph("layered", spark, sf_dir)
    pairs = _prefixed(g, "nation").select(F.col("node_id").alias("source")).crossJoin(_nation_suppliers(spark, sf_dir).select(F.col("node_id").alias("target")))
    return reach.has_path(g, pairs)


def has_path_all(spark, sf_dir):
    """Whether each nation leads to each supplier."""
    g = graph("layered", spark, sf_dir)
    pairs = _prefixed(g, "nation").select(F.col("node_id").alias("source")).crossJoin(_prefixed(g, "supplier").select(F.col("node_id").alias("target")))
    return reach.has_path(g, pairs)


def has_path_bulk(spark, sf_dir):
    """Whether each nation leads to each supplier by large lines: some do, some don't."""
    g = graph("bulk", spark, sf_dir)
    pairs = _prefixed(g, "nation").select(F.col("node_id").alias("source")).crossJoin(_prefixed(g, "supplier").select(F.col("node_id").alias("target")))
    return reach.has_path(g, pairs)


def reach_counts_parts(spark, sf_dir):
    """How many other parts each part leads to: every part is a target, and the graph has cycles."""
    g = graph("parts", spark, sf_dir)
    return reach.reach_totals(g.edges, g.nodes).select(F.col("node").alias("node_id"), "n")


def strong_components(spark, sf_dir):
    """Parts that follow one another in cycles, within orders of large lines alone."""
    g = graph("large_parts", spark, sf_dir)
    return condense.strong_components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("node").alias("node_id"), "component")


def path_parents(spark, sf_dir):
    """The next step of every part on its shortest path to part 1."""
    return reach.parents(graph("parts", spark, sf_dir), "part:1")


def shortest_path_whole(spark, sf_dir):
    """The steps from part 1 to part 2, the smallest of all shortest paths."""
    return reach.shortest_path(graph("parts", spark, sf_dir), "part:1", "part:2").select("hops", F.array_join("path", ">").alias("path"))


def inbound_paths_whole(spark, sf_dir):
    """The sixty nearest parts before part 1, with their paths as text."""
    return reach.inbound_paths(graph("parts", spark, sf_dir), "part:1", 3, most=60)


def unreferenced_targets(spark, sf_dir):
    return cover.unreferenced_targets(graph("layered", spark, sf_dir), prefixes=("A", "NATION"), program_hint=None)


def target_set(spark, sf_dir):
    return cover.target_set(graph("layered", spark, sf_dir), prefixes=("Supplier#", "NATION"), program_hint="PLIER")[0]


def target_names(spark, sf_dir):
    """Names resolved as ids, as labels, or not at all."""
    found, missing = cover.target_set(graph("layered", spark, sf_dir), ["supplier:1", "ASIA", "nothing"])
    return found.select(F.col("node_id").alias("value"), F.lit(True).alias("found")).union(missing.select("name", F.lit(False)))


def coverage_report(spark, sf_dir):
    g = graph("layered", spark, sf_dir)
    return cover.coverage_report(g, targets=_prefixed(g, "supplier"), listed=False)


def orphans(spark, sf_dir):
    return cover.orphans(graph("layered", spark, sf_dir), targets=_nation_suppliers(spark, sf_dir))


def orphans_all(spark, sf_dir):
    """Customers that lead to no supplier."""
    g = graph("layered", spark, sf_dir)
    return cover.orphans(g, targets=_prefixed(g, "supplier"))


def orphans_bulk(spark, sf_dir):
    """Customers that lead to no supplier by large lines."""
    g = graph("bulk", spark, sf_dir)
    return cover.orphans(g, targets=_prefixed(g, "supplier"))


def coverage_lists(spark, sf_dir):
    """The suppliers that each customer leads to by large lines."""
    g = graph("bulk", spark, sf_dir)
    return cover.coverage_report(g, targets=_prefixed(g, "supplier")).select("node_id", "n_covered", F.array_join("covered", ",").alias("covered"))


def cover_steps(spark, sf_dir):
    g = graph("layered", spark, sf_dir)
    return cover.greedy_cover(g, targets=_prefixed(g, "supplier")).hooks.select("step", "node_id", "gain")


def cover_uncovered(spark, sf_dir):
    """Regions and suppliers as targets: no customer reaches a region."""
    g = graph("layered", spark, sf_dir)
    return cover.greedy_cover(g, targets=_prefixed(g, "region").union(_prefixed(g, "supplier"))).uncovered


def wcc_sizes(spark, sf_dir):
    return structure.component_sizes(graph("parts", spark, sf_dir))


def wcc_tiers(spark, sf_dir):
    return structure.weak_components(graph("tiers", spark, sf_dir))


def largest_wcc(spark, sf_dir):
    return structure.largest_component(graph("tiers", spark, sf_dir)).nodes.select("node_id")


def topk_subgraph(spark, sf_dir):
    return structure.top_k_subgraph(graph("supplies", spark, sf_dir), 150).nodes.select("node_id")


def balanced_subgraph(spark, sf_dir):
    return structure.balanced_subgraph(graph("tiers", spark, sf_dir), 60).nodes.select("node_id")


def pagerank_k(spark, sf_dir):
    return centrality.pagerank(graph("parts", spark, sf_dir), iterations=5).select("node_id", F.round("rank", 8).alias("rank"))


def pagerank_dangling(spark, sf_dir):
    return centrality.pagerank(graph("supplies", spark, sf_dir), iterations=3).select("node_id", F.round("rank", 8).alias("rank"))


def betweenness_tiers(spark, sf_dir):
    return centrality.betweenness(graph("tiers", spark, sf_dir)).select("node_id", F.round("betweenness", 6).alias("betweenness"))


def centrality_summary(spark, sf_dir):
    return centrality.summary(graph("supplies", spark, sf_dir), "Degree", RANKS)[1].select("node_id", "score")


def dense_index(spark, sf_dir):
    return graph("tiers", spark, sf_dir).dense_index()


def compose(spark, sf_dir):
    """supplies and parts as one graph: the later program wins."""
    g = PropertyGraph.compose([graph("supplies", spark, sf_dir), graph("parts", spark, sf_dir)])
    return g.counts()


def dangling_edges(spark, sf_dir):
    g = graph("links", spark, sf_dir)
    return quality.dangling_edges(g.nodes, g.edges)


def colours(spark, sf_dir):
    return labels.with_colour_index(graph("supplies", spark, sf_dir).nodes, 8).select("node_id", "colour")


def node_sizes(spark, sf_dir):
    g = graph("parts", spark, sf_dir)
    return labels.with_size(g.degrees(), "degree").select("node_id", F.round("size", 6).alias("size"))


def hubs(spark, sf_dir):
    return labels.with_hub(graph("parts", spark, sf_dir).degrees(), "degree").where("hub").select("node_id", "degree")


def display_labels(spark, sf_dir):
    return graph("layered", spark, sf_dir).nodes.select("node_id", labels.display_label().alias("label"))


SEARCHED = ("gear", "RING", "0001", "e r", "no such label")


def label_search(spark, sf_dir):
    """The suppliers and parts whose label holds each of some texts."""
    index = LabelIndex.of(graph("supplies", spark, sf_dir))
    return reduce(DataFrame.unionByName, [index.search(text).withColumn("text", F.lit(text)) for text in SEARCHED])


def explore_view(spark, sf_dir):
    """Callers of supplier 1 and the path from nation 0, over the tiers of orders."""
    view = explore(graph("layered", spark, sf_dir), limit=200, focus="supplier:1", start="nation:0", depth=2)
    return view.paths.select("node_id", "hops")


def explore_elements(spark, sf_dir):
    """What a widget shows of all tiers, with what leads to customer 1 marked."""
    return explore(graph("tiers", spark, sf_dir), limit=1_000_000_000, focus="customer:1", depth=3).elements


ALL = [
    graph_counts, degree_all, in_degree, out_degree, nodes_per_program, nodes_per_layer, programs, top_degree, balanced_topk, balanced_topk_all, neighbors_out, neighbors_in,
    khop_inbound, induced_edges, shortest_path_len, shortest_path, inbound_paths, ancestors, ancestors_suppliers, descendants, reach_all_pairs, has_path, has_path_all, has_path_bulk, reach_counts_parts, strong_components, path_parents, shortest_path_whole, inbound_paths_whole, unreferenced_targets, target_set,
    target_names, coverage_report, orphans, orphans_all, orphans_bulk, coverage_lists, cover_steps, cover_uncovered, wcc_sizes, wcc_tiers, largest_wcc, topk_subgraph, balanced_subgraph, pagerank_k,
    pagerank_dangling, betweenness_tiers, centrality_summary, dense_index, compose, dangling_edges, colours, node_sizes, hubs, display_labels, label_search, explore_view, explore_elements,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in ALL}

# --- SQL ---

TIERS = """
tn AS (SELECT 'region:' || r_regionkey AS id, 'region' AS program, r_name AS name, NULL AS source FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, NULL FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, c_mktsegment, c_name, 'DEFAULT' FROM customer),
te AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
 UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer)"""
LAYERED = TIERS + """,
ln AS (SELECT * FROM tn UNION ALL SELECT 'orders:' || o_orderkey, 'orders', NULL, NULL FROM orders
 UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, NULL FROM supplier),
le AS (SELECT * FROM te UNION SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders
 UNION SELECT 'orders:' || l_orderkey, 'supplier:' || l_suppkey FROM lineitem)"""
PARTS = """
pw AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
pn AS (SELECT 'part:' || p_partkey AS id, p_brand AS program, p_name AS name FROM part),
pe AS (SELECT DISTINCT 'part:' || a AS src, 'part:' || b AS dst FROM pw WHERE b IS NOT NULL)"""
SUPPLIES = """
sn AS (SELECT 'supplier:' || s_suppkey AS id, 'supplier' AS program, s_name AS name FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_brand, p_name FROM part),
se AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem)"""


def _degrees(nodes: str, edges: str) -> str:
    return f"deg AS (SELECT id, coalesce(o, 0) AS o, coalesce(i, 0) AS i, coalesce(o, 0) + coalesce(i, 0) AS d FROM {nodes} LEFT JOIN (SELECT src, count(*) AS o FROM {edges} GROUP BY 1) ON src = id LEFT JOIN (SELECT dst, count(*) AS i FROM {edges} GROUP BY 1) ON dst = id)"


def _pagerank(head: str, nodes: str, edges: str, rounds: int) -> str:
    ctes = [f"outd AS MATERIALIZED (SELECT src, count(*) AS links FROM {edges} GROUP BY 1)", f"num AS MATERIALIZED (SELECT count(*) AS n FROM {nodes})", f"r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM {nodes}, num)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        ctes += [
            f"g{k} AS MATERIALIZED (SELECT e.dst, sum(rank / links) AS g FROM {edges} e JOIN outd USING (src) JOIN {p} ON {p}.id = e.src GROUP BY 1)",
            f"s{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS spare FROM {p} WHERE id NOT IN (SELECT src FROM outd))",
            f"r{k} AS MATERIALIZED (SELECT {p}.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g, 0) + spare / n) AS rank FROM {p} LEFT JOIN g{k} ON dst = {p}.id, num, s{k})",
        ]
    return f"WITH {head}, {', '.join(ctes)} SELECT id AS node_id, round(rank, 8) AS rank FROM r{rounds}"


def _hops(edges: str, seed: str, most: int, inbound: bool) -> str:
    at, to = ("dst", "src") if inbound else ("src", "dst")
    return f"hop(id, d) AS (SELECT '{seed}', 0 UNION SELECT {edges}.{to}, d + 1 FROM hop JOIN {edges} ON {edges}.{at} = hop.id WHERE d < {most}), near AS (SELECT id, min(d) AS d FROM hop GROUP BY 1)"


def _largest(edges: str) -> str:
    """Of the nodes of k(id), the largest component; among equals that of the smallest id."""
    return f"""u AS (SELECT src AS a, dst AS b FROM {edges} WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)), v AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
cc(node, label) USING KEY (node) AS (SELECT id, id FROM k UNION (SELECT v.b, min(cc.label) FROM cc JOIN v ON cc.node = v.a JOIN recurring.cc r ON r.node = v.b WHERE cc.label < r.label GROUP BY v.b)),
best AS (SELECT label FROM cc GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT node AS node_id FROM cc WHERE label = (SELECT label FROM best)"""


def _balanced(where: str, limit: int) -> str:
    """The balanced sample as k(id), from deg and the nodes nn(id, program)."""
    return f"""p AS (SELECT id, d, program, row_number() OVER (PARTITION BY program ORDER BY d DESC, id) AS rn, min(id) OVER (PARTITION BY program) AS first FROM deg JOIN nn USING (id) WHERE {where}),
q AS (SELECT *, rn <= greatest(1, ceil({limit}.0 / (SELECT count(DISTINCT program) FROM p))) AS chosen FROM p),
k AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY chosen DESC, CASE WHEN chosen THEN first END, CASE WHEN chosen THEN rn END, d DESC, id) AS place FROM q) WHERE place <= {limit})"""


CUSTOMER_SUPPLIER = "cs AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
BULK = "cs AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49)"
LARGE_PARTS = "lw AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity >= 40), e AS (SELECT DISTINCT a, b FROM lw WHERE a <> b)"
#: Of each node of near its smallest next node on a shortest path.
NEXT = "nxt AS (SELECT src AS id, min(dst) AS next FROM pe JOIN near a ON a.id = src JOIN near b ON b.id = dst WHERE b.d = a.d - 1 GROUP BY src)"

ORACLE_SQL: dict[str, str] = {
    "graph_counts": f"WITH {PARTS} SELECT (SELECT count(*) FROM pn) AS node_count, (SELECT count(*) FROM pe) AS edge_count",
    "degree_all": f"WITH {PARTS}, {_degrees('pn', 'pe')} SELECT id AS node_id, d AS degree FROM deg",
    "in_degree": f"WITH {PARTS}, {_degrees('pn', 'pe')} SELECT id AS node_id, i AS in_degree FROM deg",
    "out_degree": f"WITH {SUPPLIES}, {_degrees('sn', 'se')} SELECT id AS node_id, o AS out_degree FROM deg",
    "nodes_per_program": f"WITH {SUPPLIES} SELECT program, count(*) AS node_count FROM sn GROUP BY 1",
    "nodes_per_layer": f"WITH {LAYERED} SELECT 'library' AS layer, count(*) AS node_count FROM ln",
    "programs": f"WITH {LAYERED} SELECT DISTINCT program FROM ln",
    "top_degree": f"WITH {SUPPLIES}, {_degrees('sn', 'se')} SELECT id AS node_id, d AS degree FROM deg ORDER BY d DESC, id LIMIT 10",
    "centrality_summary": f"WITH {SUPPLIES}, {_degrees('sn', 'se')} SELECT id AS node_id, d::DOUBLE AS score FROM deg ORDER BY d DESC, id LIMIT 10",
    "balanced_topk": f"WITH {SUPPLIES}, {_degrees('sn', 'se')}, nn AS (SELECT * FROM sn), {_balanced("id LIKE 'part:%'", 100)} SELECT id AS node_id FROM k",
    "balanced_topk_all": f"WITH {SUPPLIES}, {_degrees('sn', 'se')}, nn AS (SELECT * FROM sn), {_balanced('true', 100)} SELECT id AS node_id FROM k",
    "topk_subgraph": f"WITH RECURSIVE {SUPPLIES}, {_degrees('sn', 'se')}, k AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 150), {_largest('se')}",
    "balanced_subgraph": f"WITH RECURSIVE {TIERS}, {_degrees('tn', 'te')}, nn AS (SELECT * FROM tn), {_balanced('true', 60)}, {_largest('te')}",
    "neighbors_out": f"WITH {PARTS} SELECT dst AS node_id FROM pe WHERE src = 'part:1'",
    "neighbors_in": f"WITH {PARTS} SELECT src AS node_id FROM pe WHERE dst = 'part:1'",
    "khop_inbound": f"WITH RECURSIVE {PARTS}, {_hops('pe', 'part:1', 2, True)} SELECT id AS node_id, d AS depth FROM near",
    "induced_edges": f"WITH {PARTS}, k AS (SELECT 'part:1' AS id UNION SELECT src FROM pe WHERE dst = 'part:1') SELECT src, dst FROM pe WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "shortest_path_len": f"WITH RECURSIVE {PARTS}, {_hops('pe', 'part:1', 20, False)} SELECT id AS node_id, d AS depth FROM near",
    "shortest_path": f"WITH RECURSIVE {PARTS}, {_hops('pe', 'part:1', 20, False)} SELECT d AS hops, d + 1 AS nodes FROM near WHERE id = 'part:2'",
    "inbound_paths": f"WITH RECURSIVE {LAYERED}, {_hops('le', 'supplier:1', 3, True)} SELECT id AS node_id, d AS hops FROM near WHERE d > 0 ORDER BY d, id LIMIT 12",
    "explore_view": f"WITH RECURSIVE {LAYERED}, {_hops('le', 'supplier:1', 2, True)} SELECT id AS node_id, d AS hops FROM near WHERE d > 0 ORDER BY d, id LIMIT 12",
    "ancestors": f"WITH RECURSIVE {PARTS}, c(node, target) AS (SELECT id, id FROM pn WHERE split_part(id, ':', 2)::INT < 20 UNION SELECT src, target FROM c JOIN pe ON dst = node) SELECT node, target FROM c WHERE node <> target",
    "ancestors_suppliers": f"WITH RECURSIVE {LAYERED}, c(node, target) AS (SELECT id, id FROM ln WHERE id LIKE 'supplier:%' UNION SELECT src, target FROM c JOIN le ON dst = node) SELECT node, target FROM c WHERE node <> target",
    "descendants": f"WITH RECURSIVE {LAYERED}, c(node, source) AS (SELECT id, id FROM ln WHERE id LIKE 'region:%' UNION SELECT dst, source FROM c JOIN le ON src = node) SELECT node, source FROM c WHERE node LIKE 'supplier:%'",
    "reach_all_pairs": f"WITH RECURSIVE {TIERS}, c(node, target, depth) AS (SELECT id, id, 0 FROM tn UNION SELECT src, target, depth + 1 FROM c JOIN te ON dst = node) SELECT node, target, depth FROM c WHERE node <> target",
    "has_path": f"""WITH RECURSIVE {LAYERED}, c(node, target) AS (SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 0 UNION SELECT src, target FROM c JOIN le ON dst = node)
SELECT 'nation:' || n_nationkey AS source, 'supplier:' || s_suppkey AS target, EXISTS (SELECT 1 FROM c WHERE node = 'nation:' || n_nationkey AND target = 'supplier:' || s_suppkey) AS reachable FROM nation, supplier WHERE s_nationkey = 0""",
    "has_path_all": f"""WITH RECURSIVE {LAYERED}, c(node, target) AS (SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey FROM supplier UNION SELECT src, target FROM c JOIN le ON dst = node)
SELECT a.id AS source, b.id AS target, c.node IS NOT NULL AS reachable FROM ln a JOIN ln b ON a.program = 'nation' AND b.program = 'supplier' LEFT JOIN c ON c.node = a.id AND c.target = b.id""",
    "has_path_bulk": f"""WITH cs AS (SELECT DISTINCT c_nationkey AS n, l_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49)
SELECT 'nation:' || n_nationkey AS source, 'supplier:' || s_suppkey AS target, cs.n IS NOT NULL AS reachable FROM nation JOIN supplier ON true LEFT JOIN cs ON n = n_nationkey AND s = s_suppkey""",
    "reach_counts_parts": f"WITH RECURSIVE {PARTS}, e AS (SELECT DISTINCT a, b FROM pw WHERE b IS NOT NULL), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b) SELECT 'part:' || a AS node_id, count(*) AS n FROM c WHERE a <> b GROUP BY a",
    "strong_components": f"""WITH RECURSIVE {LARGE_PARTS}, c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
SELECT 'part:' || x.a AS node_id, min('part:' || y.a) AS component FROM c x JOIN c y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(DISTINCT y.a) > 1""",
    "path_parents": f"WITH RECURSIVE {PARTS}, {_hops('pe', 'part:1', 20, True)}, {NEXT} SELECT near.id AS node_id, d AS depth, next FROM near LEFT JOIN nxt USING (id)",
    "shortest_path_whole": f"""WITH RECURSIVE {PARTS}, {_hops('pe', 'part:2', 20, True)}, {NEXT}, w(id, hops, path) AS (SELECT 'part:1', 0, 'part:1' UNION ALL SELECT next, hops + 1, path || '>' || next FROM w JOIN nxt USING (id))
SELECT hops, path FROM w ORDER BY hops DESC LIMIT 1""",
    "inbound_paths_whole": f"""WITH RECURSIVE {PARTS}, {_hops('pe', 'part:1', 3, True)}, {NEXT}, top AS (SELECT id, d FROM near WHERE d > 0 ORDER BY d, id LIMIT 60),
w(start, id, path) AS (SELECT top.id, top.id, name FROM top JOIN pn USING (id) UNION ALL SELECT start, next, path || ' → ' || name FROM w JOIN nxt USING (id) JOIN pn ON pn.id = next)
SELECT name AS source, d AS hops, w.path, top.id AS node_id FROM top JOIN w ON start = top.id AND w.id = 'part:1' JOIN pn ON pn.id = top.id""",
    "unreferenced_targets": f"WITH {LAYERED} SELECT id AS node_id FROM ln WHERE (name LIKE 'A%' OR name LIKE 'NATION%') AND id NOT IN (SELECT dst FROM le)",
    "target_set": "SELECT 'supplier:' || s_suppkey AS node_id FROM supplier WHERE s_name LIKE 'Supplier#%'",
    "target_names": "SELECT 'supplier:1' AS value, true AS found UNION ALL SELECT 'region:' || r_regionkey, true FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'nothing', false",
    "coverage_report": f"WITH {CUSTOMER_SUPPLIER} SELECT 'customer:' || c_custkey AS node_id, c_name AS label, c_mktsegment AS program, count(s) AS n_covered FROM customer LEFT JOIN cs ON c = c_custkey GROUP BY ALL",
    "orphans": f"WITH {CUSTOMER_SUPPLIER} SELECT 'customer:' || c_custkey AS node_id, c_name AS label, c_mktsegment AS program FROM customer WHERE c_custkey NOT IN (SELECT c FROM cs JOIN supplier ON s = s_suppkey WHERE s_nationkey = 0)",
    "orphans_all": f"WITH {CUSTOMER_SUPPLIER} SELECT 'customer:' || c_custkey AS node_id, c_name AS label, c_mktsegment AS program FROM customer WHERE c_custkey NOT IN (SELECT c FROM cs JOIN supplier ON s = s_suppkey)",
    "orphans_bulk": f"WITH {BULK} SELECT 'customer:' || c_custkey AS node_id, c_name AS label, c_mktsegment AS program FROM customer WHERE c_custkey NOT IN (SELECT c FROM cs)",
    "coverage_lists": f"WITH {BULK} SELECT 'customer:' || c_custkey AS node_id, count(s) AS n_covered, coalesce(string_agg('supplier:' || s, ',' ORDER BY 'supplier:' || s), '') AS covered FROM customer LEFT JOIN cs ON c = c_custkey GROUP BY 1",
    "cover_steps": f"""WITH RECURSIVE {CUSTOMER_SUPPLIER}, sets AS MATERIALIZED (SELECT 'customer:' || c AS node, list(s) AS l FROM cs GROUP BY c),
g(step, node_id, gain, rest) AS (
 SELECT 0, NULL::VARCHAR, 0::BIGINT, (SELECT list(DISTINCT s) FROM cs)
 UNION ALL SELECT step + 1, b.node, b.gain, list_filter(rest, lambda x: NOT list_contains(b.l, x)) FROM g, LATERAL (SELECT node, l, len(list_intersect(l, rest))::BIGINT AS gain FROM sets ORDER BY 3 DESC, 1 LIMIT 1) b WHERE b.gain > 0)
SELECT step, node_id, gain FROM g WHERE step > 0""",
    "cover_uncovered": f"WITH {CUSTOMER_SUPPLIER} SELECT 'region:' || r_regionkey AS node_id FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM cs)",
    "wcc_sizes": f"""WITH RECURSIVE {PARTS}, u AS (SELECT src AS a, dst AS b FROM pe UNION SELECT dst, src FROM pe),
cc(node, label) USING KEY (node) AS (SELECT id, id FROM pn UNION (SELECT u.b, min(cc.label) FROM cc JOIN u ON cc.node = u.a JOIN recurring.cc r ON r.node = u.b WHERE cc.label < r.label GROUP BY u.b))
SELECT label AS component, count(*) AS size FROM cc GROUP BY 1""",
    "wcc_tiers": f"""WITH RECURSIVE {TIERS}, u AS (SELECT src AS a, dst AS b FROM te UNION SELECT dst, src FROM te),
cc(node, label) USING KEY (node) AS (SELECT id, id FROM tn UNION (SELECT u.b, min(cc.label) FROM cc JOIN u ON cc.node = u.a JOIN recurring.cc r ON r.node = u.b WHERE cc.label < r.label GROUP BY u.b))
SELECT node AS node_id, label AS component FROM cc""",
    "largest_wcc": f"""WITH {TIERS}, r AS (SELECT id, n_regionkey AS r FROM tn JOIN nation ON id = 'nation:' || n_nationkey UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'region:' || r_regionkey, r_regionkey FROM region),
s AS (SELECT r, count(*) AS n, min(id) AS first FROM r GROUP BY 1 ORDER BY n DESC, first LIMIT 1) SELECT id AS node_id FROM r WHERE r = (SELECT r FROM s)""",
    "pagerank_k": _pagerank(PARTS, "pn", "pe", 5),
    "pagerank_dangling": _pagerank(SUPPLIES, "sn", "se", 3),
    "betweenness_tiers": """SELECT 'region:' || r_regionkey AS node_id, 0.0::DOUBLE AS betweenness FROM region UNION ALL SELECT 'customer:' || c_custkey, 0.0 FROM customer
UNION ALL SELECT 'nation:' || n_nationkey, count(c_custkey)::DOUBLE FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
    "dense_index": f"WITH {TIERS} SELECT id AS node_id, row_number() OVER (ORDER BY id) - 1 AS idx FROM tn",
    "compose": f"WITH {SUPPLIES}, {PARTS} SELECT (SELECT count(*) FROM (SELECT id FROM sn UNION SELECT id FROM pn)) AS node_count, (SELECT count(*) FROM (SELECT * FROM se UNION SELECT * FROM pe)) AS edge_count",
    "dangling_edges": """SELECT DISTINCT 'page:' || page_id AS src, 'link:' || href AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)""",
    "colours": f"WITH {SUPPLIES} SELECT id AS node_id, ((dense_rank() OVER (ORDER BY program) - 1) % 8)::INT AS colour FROM sn",
    "node_sizes": f"WITH {PARTS}, {_degrees('pn', 'pe')}, m AS (SELECT min(d) AS a, max(d) AS b FROM deg) SELECT id AS node_id, round(CASE WHEN a = b THEN 28.0::DOUBLE ELSE 18.0::DOUBLE + (d - a)::DOUBLE / (b - a) * 28.0::DOUBLE END, 6) AS size FROM deg, m",
    "hubs": f"WITH {PARTS}, {_degrees('pn', 'pe')}, k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS place FROM deg) SELECT id AS node_id, d AS degree FROM deg WHERE d >= (SELECT d FROM k WHERE place = greatest(0, floor((SELECT count(*) FROM deg) * 0.85) - 1))",
    "explore_elements": f"""WITH {TIERS}, {_degrees('tn', 'te')}, near AS (SELECT 'customer:1' AS id UNION ALL SELECT 'nation:' || c_nationkey FROM customer WHERE c_custkey = 1
UNION ALL SELECT 'region:' || n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey = 1)
SELECT 'nodes' AS "group", id, program || ':' || name AS label, program, d AS degree, 22.0::DOUBLE AS size, false AS hub, ((dense_rank() OVER (ORDER BY program) - 1) % 8)::INT AS colour, NULL AS source, NULL AS target, CASE WHEN id IN (SELECT id FROM near) THEN 'highlight' ELSE '' END AS classes FROM tn JOIN deg USING (id)
UNION ALL SELECT 'edges', 'main-edge-' || (row_number() OVER (ORDER BY src || chr(0) || dst) - 1), NULL, NULL, NULL, NULL, NULL, NULL, src, dst, CASE WHEN src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near) THEN 'highlight' ELSE '' END FROM te""",
    "label_search": f"WITH {SUPPLIES} SELECT id AS node_id, coalesce(name, id) AS label, text FROM sn JOIN (VALUES {', '.join(f"('{t}')" for t in SEARCHED)}) AS t(text) ON contains(lower(name), lower(text))",
    "display_labels": f"WITH {LAYERED} SELECT id AS node_id, program || ':' || CASE WHEN length(coalesce(name, id)) > 48 THEN left(coalesce(name, id), 45) || '...' ELSE coalesce(name, id) END AS label FROM ln",
}
