"""Queries over graphs: measures, clusters, enrichment, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.graph import Graph
from tessella.operators import attention as AT
from tessella.operators import betweenness as BC
from tessella.operators import blocks as BL
from tessella.operators import components as C
from tessella.operators import cores as CO
from tessella.operators import dataset as DS
from tessella.operators import density as DB
from tessella.operators import distances as D
from tessella.operators import encode as EN
from tessella.operators import enrichment as G
from tessella.operators import exact_test as ET
from tessella.operators import flow as FL
from tessella.operators import infomax as IM
from tessella.operators import local as LO
from tessella.operators import mcl as M
from tessella.operators import modularity as Q
from tessella.operators import neural as NN
from tessella.operators import nodes as N
from tessella.operators import partition as P
from tessella.operators import ranking as R
from tessella.operators import seeds as S
from tessella.operators import spectral as SP
from tessella.operators import weighted as W
from tessella.operators.cliques import maximal_clique_centrality
from tessella.plans.fixtures import CONTACTS, FOLDED_NODES, G_A, G_B, G_BW, G_C, G_CW, LINE_NODES, NODES, contact_rows, derive, graph
from tessella.plans.registry import query
from tessella.runtime import cut, scratch_path
from tessella.sources import graphs as SG
from tessella.sources import tables as ST


def ga(s, d) -> Graph:
    return graph(s, d, G_A)


def gb(s, d) -> Graph:
    return graph(s, d, G_B)


def gc(s, d) -> Graph:
    return graph(s, d, G_C)


def contacts(s, d) -> Graph:
    return Graph.from_edges(contact_rows(s, d), attrs=("weight",))


def one(s, value: float, name: str) -> DataFrame:
    return s.createDataFrame([(float(value),)], f"{name} double")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


# --- SQL building blocks ----------------------------------------------------------------------


def base(g: str) -> str:
    """e edges, s both directions, v nodes, dg degrees."""
    return f"""e as materialized (select u, v from ({g}) g), s as materialized (select u a, v b from e union all select v, u from e),
 v as materialized (select distinct a n from s), dg as materialized (select a n, count(*) k from s group by 1)"""


CC = """r(n,l) as (select distinct a, a from s union select s.b, r.l from r join s on s.a = r.n where r.l < s.b),
 cc as materialized (select n, min(l) c from r group by 1)"""
# The same with one row kept for each node, for large components.
CC_KEYED = """r(n,l) using key (n) as (select n, n from v union select s.b, min(q.l) from r q join s on s.a = q.n join recurring.r t on t.n = s.b where q.l < t.l group by s.b),
 cc as materialized (select n, l c from r)"""
# Breadth-first distances from every node, for graphs with small components.
DIST = """w(src,n,d) as (select n, n, 0 from v union select w.src, s.b, w.d+1 from w join s on s.a = w.n where w.d < 60 and not exists (select 1 from w p where p.src = w.src and p.n = s.b)),
 ds as materialized (select src, n, min(d) d from w group by 1, 2)"""
TRI = "t as materialized (select e1.u a, e1.v b, e2.v c from e e1 join e e2 on e1.v = e2.u join e e3 on e3.u = e1.u and e3.v = e2.v)"
TN = "tn as materialized (select n, count(*) t from (select a n from t union all select b from t union all select c from t) x group by 1)"
CN = "cn as materialized (select e.u, e.v, count(s2.b) w from e left join s s1 on s1.a = e.u left join s s2 on s2.a = e.v and s2.b = s1.b group by 1, 2)"


def rec(*parts: str) -> str:
    return "with recursive " + ", ".join(parts)


# --- components and local measures ------------------------------------------------------------


@query("connected_components", f"{rec(base(G_B), CC)} select n as node_id, c as component_id from cc")
def _(s, d):
    return C.connected_components(gb(s, d))


@query("component_sizes", f"{rec(base(G_A), CC)} select n_nodes, count(*) as n_components from (select c, count(*) n_nodes from cc group by 1) x group by 1")
def _(s, d):
    return C.component_sizes(C.connected_components(ga(s, d))).groupBy("n_nodes").agg(F.count("*").alias("n_components"))


@query("components_within_size", f"{rec(base(G_A), CC)} select n as node_id, cc.c as component_id, n_nodes from cc join (select c, count(*) n_nodes from cc group by 1) x on x.c = cc.c where n_nodes between 4 and 30")
def _(s, d):
    return C.components_within(C.connected_components(ga(s, d)), 4, 30).select("node_id", "component_id", "n_nodes")


@query("remove_self_loops", "select distinct least(l_partkey % 97, l_suppkey % 97) as u, greatest(l_partkey % 97, l_suppkey % 97) as v from {lineitem} where l_partkey % 97 <> l_suppkey % 97")
def _(s, d):
    loose = derive(s, d, "select l_partkey % 97 as u, l_suppkey % 97 as v from {lineitem}")
    return Graph.from_edges(loose).without_loops().edges


@query("graph_fingerprint")
def _(s, d):
    return D.graph_fingerprint(gb(s, d))


@query("measure_degree", f"{rec(base(G_B))} select n as node_id, round(k/((select count(*) from v)-1),8) as degree from dg")
def _(s, d):
    return LO.degree_centrality(gb(s, d)).withColumn("degree", F.round("degree", 8))


@query("measure_triangles", f"{rec(base(G_B), TRI, TN)} select v.n as node_id, coalesce(t,0) as triangles from v left join tn on tn.n = v.n")
def _(s, d):
    return LO.triangles(gb(s, d))


@query("measure_transitivity", f"{rec(base(G_B), TRI)} select round(3.0*(select count(*) from t)/(select sum(k*(k-1)/2) from dg),6) as transitivity")
def _(s, d):
    return LO.transitivity(gb(s, d))


@query("measure_local_clustering", f"{rec(base(G_B), TRI, TN)} select dg.n as node_id, case when k < 2 then 0.0 else round(2.0*coalesce(t,0)/(k*(k-1)),6) end as local_clustering from dg left join tn on tn.n = dg.n")
def _(s, d):
    return r6(LO.local_clustering(gb(s, d)), "local_clustering")


@query("measure_degree_assortativity", f"{rec(base(G_B))} select round(corr(x.k, y.k),5) as deg_assortativity from s join dg x on x.n = s.a join dg y on y.n = s.b")
def _(s, d):
    return LO.degree_assortativity(gb(s, d))


_ATT = f"att as materialized (select n, p_size z, p_size % 2 y from ({LINE_NODES}) ln join {{part}} on p_partkey = pk)"


@query("measure_numeric_assortativity", f"{rec(base(G_B), _ATT)} select round(corr(x.z, y.z),6)+0.0 as assortativity from s join att x on x.n = s.a join att y on y.n = s.b")
def _(s, d):
    g = gb(s, d)
    att = derive(s, d, f"select n as node_id, p_size as z from ({LINE_NODES}) ln join {{part}} on p_partkey = pk")
    return r6(LO.numeric_assortativity(Graph(g.vertices.join(att, "node_id"), g.edges), "z"), "assortativity")


@query("measure_categorical_assortativity", f"""{rec(base(G_B), _ATT)}, m as (select x.y i, y.y j, count(*)::double k from s join att x on x.n = s.a join att y on y.n = s.b group by 1, 2), t as (select sum(k) k from m),
 ab as (select sum(rs*rs) q from (select i, sum(k)/(select k from t) rs from m group by 1) z) select round(((select sum(k) from m where i = j)/(select k from t) - q)/(1 - q),6)+0.0 as assortativity from ab""")
def _(s, d):
    g = gb(s, d)
    att = derive(s, d, f"select n as node_id, p_size % 2 as y from ({LINE_NODES}) ln join {{part}} on p_partkey = pk")
    return r6(LO.categorical_assortativity(Graph(g.vertices.join(att, "node_id"), g.edges), "y"), "assortativity")


@query("edge_common_neighbours", f"{rec(base(G_B), CN)} select u, v, w as common from cn")
def _(s, d):
    return LO.edge_triangles(gb(s, d))


# --- distances --------------------------------------------------------------------------------


@query("measure_closeness", f"{rec(base(G_A), DIST)} select src as node_id, round(sum(case when d > 0 then 1.0/d else 0 end),6) as closeness_centrality from ds group by 1")
def _(s, d):
    return r6(D.harmonic(ga(s, d)), "closeness_centrality")


@query("measure_shortest_path_length", f"{rec(base(G_A), DIST)} select src as node_id, round(sum(d)/((select count(*) from v)-1),8) as shortest_path_length from ds group by 1")
def _(s, d):
    return D.mean_distance_per_node(ga(s, d)).withColumn("shortest_path_length", F.round("shortest_path_length", 8))


@query("measure_avg_short_path_len", f"""{rec(base(G_A), CC, DIST)}, z as (select c, count(*) n from cc group by 1) select z.c as component_id, z.n as n_nodes, round(sum(d)/(z.n*(z.n-1)),6) as avg_short_path_len
 from ds join cc on cc.n = ds.src join z on z.c = cc.c group by 1, 2""")
def _(s, d):
    return r6(D.mean_distance_per_component(ga(s, d)), "avg_short_path_len")


@query("measure_global_efficiency", f"{rec(base(G_A), DIST)} select round(sum(case when d > 0 then 1.0/d else 0 end)/((select count(*) from v)*((select count(*) from v)-1)),9) as global_efficiency from ds")
def _(s, d):
    return D.global_efficiency(ga(s, d)).select(F.round("global_efficiency", 9).alias("global_efficiency"))


@query("measure_local_efficiency", f"""{rec(base(G_B))}, p as materialized (select x.a c, x.b i, y.b j from s x join s y on y.a = x.a and y.b <> x.b), a as materialized (select p.c, p.i, p.j from p join s on s.a = p.i and s.b = p.j),
 w(c,i,j,d) as (select c, i, j, 1 from a union select w.c, w.i, a.j, w.d+1 from w join a on a.c = w.c and a.i = w.j where a.j <> w.i and w.d < 12),
 m as (select c, i, j, min(d) d from w group by 1,2,3), h as (select c, sum(1.0/d) x from m group by 1) select round(sum(x/(k*(k-1)))/(select count(*) from v),6) as local_efficiency from h join dg on dg.n = h.c""")
def _(s, d):
    return r6(D.local_efficiency(gb(s, d)), "local_efficiency")


def _weighted_base(g: str) -> str:
    return f"e as materialized ({g}), s as materialized (select u a, v b, abs(weight) w from e union all select v, u, abs(weight) from e), v as materialized (select distinct a n from s)"


def _squarings(rounds: int = 4) -> str:
    """Shortest lengths over at most 2^rounds edges, for graphs with small components."""
    step = ["p0 as materialized (select src, n, min(d) d from (select n src, n, 0.0::double d from v union all select a, b, w from s) x group by 1, 2)"]
    step += [f"p{i} as materialized (select x.src, y.n, min(x.d+y.d) d from p{i - 1} x join p{i - 1} y on y.src = x.n group by 1, 2)" for i in range(1, rounds + 1)]
    return ", ".join(step)


@query("measure_weighted_path_length", f"with {_weighted_base(G_BW)}, {_squarings()} select src as node_id, round(-avg(d),6)+0.0 as avg_w_shortest_path_length from p4 where src <> n group by 1")
def _(s, d):
    return r6(W.mean_weighted_distance(graph(s, d, G_BW, ("weight",))), "avg_w_shortest_path_length")


@query("weighted_distances_from_least", f"""{rec(_weighted_base(G_CW))}, q(n,d) using key (n) as (select min(n), 0.0::double from v union
 select s.b, min(q.d+s.w) from q join s on s.a = q.n left join recurring.q t on t.n = s.b where t.n is null or q.d+s.w < t.d group by s.b)
 select (select min(n) from v) as src, n as node_id, d from q""")
def _(s, d):
    g = graph(s, d, G_CW, ("weight",))
    return W.weighted_distances(g, g.vertices.agg(F.min("node_id").alias("node_id")))


@query("pairs_within_two_hops", f"""{rec(base(G_A))} select src, dst, min(d) as d from (select n src, n dst, 0 d from v union all select a, b, 1 from s union all select x.a, y.b, 2 from s x join s y on y.a = x.b) z group by 1, 2""")
def _(s, d):
    return D.pairs_within(ga(s, d), 2)


@query("distance_profile", f"{rec(base(G_A), DIST)} select src as node_id, d, count(*) as n from ds where d > 0 group by 1, 2")
def _(s, d):
    return D.distance_profile(ga(s, d))


# Shortest-path counts: walks of length d(s, t), counted level by level inside the distance table.
SIGMA = """sg(k,src,n,c) as (select 0, n, n, 1.0::double from v union all select k+1, src, b, sum(c) from (select sg.k, sg.src, s.b, sg.c from sg join s on s.a = sg.n join ds on ds.src = sg.src and ds.n = s.b and ds.d = sg.k+1) x group by 1,2,3),
 pc as materialized (select src, n, k d, c from sg)"""


@query("measure_betweenness", f"""{rec(base(G_A), DIST, SIGMA)}, b as (select x.n, sum(x.c*y.c/z.c)/2 b from pc z join pc x on x.src = z.src join pc y on y.src = z.n and y.n = x.n where x.d + y.d = z.d and x.n <> z.src and x.n <> z.n group by 1)
 select v.n as node_id, round(coalesce(b,0),6) as betweenness from v left join b on b.n = v.n""")
def _(s, d):
    return r6(BC.betweenness(ga(s, d)), "betweenness")


@query("measure_edge_betweenness", f"""{rec(base(G_A), DIST, SIGMA)}, b as (select least(s.a,s.b) u, greatest(s.a,s.b) v, sum(x.c*y.c/z.c)/2 b from pc z join pc x on x.src = z.src join s on s.a = x.n join pc y on y.src = z.n and y.n = s.b where x.d + y.d + 1 = z.d group by 1,2)
 select e.u, e.v, round(coalesce(b,0),6) as edge_betweenness from e left join b on b.u = e.u and b.v = e.v""")
def _(s, d):
    return r6(BC.edge_betweenness(ga(s, d)), "edge_betweenness")


@query("measure_betweenness_sampled")
def _(s, d):
    return BC.betweenness(ga(s, d), pivots=200)


# --- iterative measures -----------------------------------------------------------------------


@query("measure_pagerank", f"""{rec(base(G_B))}, p(i,n,x,err) as (select 0, n, 1.0/(select count(*) from v), 1e9::double from v union all
 select i+1, n, y, sum(abs(y-x)) over () from (select p.i, p.n, any_value(p.x) x, 0.85*sum(q.x/dg.k)+0.15/(select count(*) from v) y from p join s on s.b = p.n join p q on q.n = s.a join dg on dg.n = s.a where p.err >= 1e-6*(select count(*) from v) group by 1,2) z)
 select n as node_id, round(x,8) as pagerank from p where i = (select max(i) from p)""")
def _(s, d):
    return R.pagerank(gb(s, d)).withColumn("pagerank", F.round("pagerank", 8))


@query("measure_eigenvector", f"""{rec(base(G_B))}, p(i,n,x,err) as (select 0, n, 1.0::double/(select count(*) from v), 1e9::double from v union all
 select i+1, n, z, sum(abs(z-x)) over () from (select i, n, x, y/sqrt(sum(y*y) over ()) z from (select p.i, p.n, any_value(p.x) x, any_value(p.x)+sum(q.x) y from p join s on s.b = p.n join p q on q.n = s.a where p.err >= 1e-6*(select count(*) from v) group by 1,2) a) b)
 select n as node_id, round(x,5)+0.0 as eigenvector from p where i = (select max(i) from p)""")
def _(s, d):
    return R.eigenvector(gb(s, d)).withColumn("eigenvector", F.round("eigenvector", 5) + 0.0)


def _core_sql(rounds: int = 14) -> str:
    """Unrolled h-index lowering, as many rounds as the fixtures need and more."""
    out = ["h0 as materialized (select n, k h from dg)"]
    for i in range(rounds):
        out.append(f"h{i + 1} as materialized (select n, max(least(h, rk)) h from (select s.b n, h{i}.h, row_number() over (partition by s.b order by h{i}.h desc) rk from s join h{i} on h{i}.n = s.a) x group by 1)")
    return ", ".join(out)


@query("measure_k_core", f"{rec(base(G_B))}, {_core_sql()} select n as node_id, h as k_core from h14")
def _(s, d):
    return CO.core_numbers(gb(s, d))


def _truss_sql(ks=(3, 4, 5, 6), rounds: int = 8) -> str:
    parts, ends = [], []
    for k in ks:
        parts.append(f"q{k}_0 as materialized (select u, v from e)")
        for i in range(rounds):
            p = f"q{k}_{i}"
            parts.append(f"{p}s as materialized (select u a, v b from {p} union all select v, u from {p}), q{k}_{i + 1} as materialized (select p.u, p.v from {p} p join {p}s x on x.a = p.u join {p}s y on y.a = p.v and y.b = x.b group by 1, 2 having count(*) >= {k - 2})")
        ends.append(f"select {k}::bigint as k, count(*) as n_nodes from (select u from q{k}_{rounds} union select v from q{k}_{rounds}) z having count(*) > 0")
    return ", ".join(parts) + " " + " union all ".join(ends)


@query("measure_k_truss", f"{rec(base(G_B))}, {_truss_sql()}")
def _(s, d):
    return CO.truss_sizes(gb(s, d))


@query("measure_densest_subgraph")
def _(s, d):
    density, members = CO.densest_peel(gb(s, d))
    return members.withColumn("density", F.lit(density))


@query("measure_articulation_points", f"""{rec(base(G_A), CC)}, z as (select c, count(*) n from cc group by 1), st as (select dg.n x, min(s.b) f from dg join s on s.a = dg.n where k > 1 group by 1),
 q(x,n) as (select x, f from st union select q.x, s.b from q join s on s.a = q.n where s.b <> q.x), cnt as (select x, count(*) k from q group by 1)
 select v.n as node_id, cast(case when cnt.k < z.n - 1 then 1 else 0 end as int) as articulation_point from v join cc on cc.n = v.n join z on z.c = cc.c left join cnt on cnt.x = v.n""")
def _(s, d):
    return BL.articulation_points(ga(s, d))


@query("measure_bridges", f"""{rec(base(G_B))}, q(u,v,n) as (select u, v, u from e union select q.u, q.v, s.b from q join s on s.a = q.n where not (s.a = q.u and s.b = q.v) and not (s.a = q.v and s.b = q.u))
 select u, v from e where not exists (select 1 from q where q.u = e.u and q.v = e.v and q.n = e.v)""")
def _(s, d):
    return BL.bridges(gb(s, d))


@query("measure_biconnected_components", f"""{rec(base(G_A), CC)},
 q(x,n,l) as (select x.n, y.n, y.n from cc x join cc y on y.c = x.c and y.n <> x.n union select q.x, s.b, q.l from q join s on s.a = q.n where s.b <> q.x and q.l < s.b), lb as materialized (select x, n, min(l) l from q group by 1, 2),
 id as materialized (select u, v, row_number() over (order by u, v) i from e), inc as materialized (select u x, v y, i from id union all select v, u, i from id),
 lk as materialized (select p.i, o.i j from inc p join lb a on a.x = p.x and a.n = p.y join inc o on o.x = p.x join lb b on b.x = o.x and b.n = o.y where a.l = b.l),
 bb(i,l) as (select i, i from id union select lk.j, bb.l from bb join lk on lk.i = bb.i where bb.l < lk.j), bl as (select i, min(l) l from bb group by 1)
 select n_edges, count(*) as n_blocks from (select l, count(*) n_edges from bl group by 1) z group by 1""")
def _(s, d):
    b = BL.blocks(ga(s, d))
    return b.groupBy("block_id").agg(F.count("*").alias("n_edges")).groupBy("n_edges").agg(F.count("*").alias("n_blocks"))


def _clique_sql() -> str:
    """Maximal cliques of 2 to 5 nodes, by joins, for graphs without larger ones."""
    cols = "abcdf"
    q = {2: "q2 as materialized (select u a, v b from e)"}
    for k in (3, 4, 5, 6):
        prev = cols[:k - 1]
        new = (cols + "g")[k - 1]
        joins = " ".join(f"join e e{i} on e{i}.u = q{k - 1}.{c}" + (f" and e{i}.v = e0.v" if i else "") for i, c in enumerate(prev))
        q[k] = f"q{k} as materialized (select {', '.join('q%d.%s' % (k - 1, c) for c in prev)}, e0.v {new} from q{k - 1} {joins})"
    out, rows = list(q.values()), []
    for k in (2, 3, 4, 5):
        mem = cols[:k]
        ext = " and ".join(f"exists (select 1 from s y{c} where y{c}.a = x.{c} and y{c}.b = z.b)" for c in mem[1:])
        out.append(f"m{k} as materialized (select x.* from q{k} x where not exists (select 1 from s z where z.a = x.a and {ext}))")
        rows += [f"select {c} n, {k} z from m{k}" for c in mem]
    return ", ".join(out) + ", mm as materialized (" + " union all ".join(rows) + ")"


@query("measure_mcc", f"""{rec(base(G_B))}, {_clique_sql()} select n as node_id, round(sum(case z when 2 then 1 when 3 then 2 when 4 then 6 else 24 end)::double/(select case max(z) when 2 then 1 when 3 then 2 when 4 then 6 else 24 end from mm),6) as mcc from mm group by 1""")
def _(s, d):
    return r6(maximal_clique_centrality(gb(s, d)), "mcc")


@query("measure_spectral_radius", f"""with recursive e as materialized ({CONTACTS}), s as materialized (select u a, v b, abs(weight) w from e union all select v, u, abs(weight) from e), v as materialized (select distinct a n from s),
 p(i,n,x,l) as (select 0, n, 1.0::double, 0.0::double from v union all select i+1, n, y/sqrt(sum(y*y) over ()), sqrt(sum(y*y) over ())/sqrt(sum(x*x) over ()) from (select p.i, p.n, any_value(p.x) x, any_value(p.x)*20+sum(s.w*q.x) y from p join s on s.b = p.n join p q on q.n = s.a where p.i < 1500 group by 1,2) z)
 select round(max(l)-20,5) as spectral_radius from p where i = 1500""")
def _(s, d):
    return one(s, round(SP.spectral_radius(contacts(s, d)), 5), "spectral_radius")


# Nations that trade: a line is a trade between the nations of its supplier and its customer.
TRADE = """select u, v from (select least(s_nationkey, c_nationkey) u, greatest(s_nationkey, c_nationkey) v, count(*) n from {lineitem}
 join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey join {supplier} on s_suppkey = l_suppkey where s_nationkey <> c_nationkey group by 1, 2) t where n % 3 = 0"""


@query("measure_algebraic_connectivity", f"""{rec(base(TRADE))},
 p(i,n,x,l) as (select 0, n, pow(n + 1, 0.7) - avg(pow(n + 1, 0.7)) over (), 0.0::double from v union all
  select i+1, n, y/sqrt(sum(y*y) over ()), sqrt(sum(y*y) over ())/sqrt(sum(x*x) over ()) from (select i, n, x, z - avg(z) over () y from (
   select p.i, p.n, any_value(p.x) x, any_value(p.x)*(60-any_value(dg.k))+sum(q.x) z from p join s on s.b = p.n join p q on q.n = s.a join dg on dg.n = p.n where p.i < 4000 group by 1, 2) z1) z2)
 select round(60-max(l),5) as alg_connectivity from p where i = 4000""")
def _(s, d):
    return one(s, round(SP.algebraic_connectivity(graph(s, d, TRADE)), 5), "alg_connectivity")


@query("measure_current_flow")
def _(s, d):
    return FL.flow_measures(ga(s, d))


@query("measure_louvain")
def _(s, d):
    return Q.louvain(gb(s, d))


# --- clustering -------------------------------------------------------------------------------


def _mcl_cc(t: float) -> str:
    return f"""k as materialized (select e.u, e.v from e join dg x on x.n = e.u join dg y on y.n = e.v where 1.0/(least(x.k, y.k)+1) >= {t}), ks as materialized (select u a, v b from k union all select v, u from k),
 r(n,l) as (select distinct a, a from ks union select ks.b, r.l from r join ks on ks.a = r.n where r.l < ks.b), cl as materialized (select n, min(l) c from r group by 1)"""


@query("cluster_mcl", f"{rec(base(G_B), _mcl_cc(0.21))} select c as cluster_id, n as node_id from cl")
def _(s, d):
    return M.markov_clusters(gb(s, d), expansion=5, inflation=3, prune=0.21, singletons=False).clusters


@query("cluster_mcl_info", f"""{rec(base(G_B), _mcl_cc(0.21))} select c as cluster_id, cl.n as node_id, 1.0/(k+1) >= 0.21 as attractor, round(case when 1.0/(k+1) >= 0.21 then 1.0/(k+1) else 0 end,6) as stability from cl join dg on dg.n = cl.n""")
def _(s, d):
    return r6(M.markov_clusters(gb(s, d), expansion=5, inflation=3, prune=0.21, singletons=False).info, "stability")


@query("cluster_mcl_edges", f"""{rec(base(G_B), _mcl_cc(0.21))} select c as cluster_id, x.src, x.dst, round(1.0/(k+1),6) as weight from (select a src, b dst from s union all select n, n from v) x join dg on dg.n = x.src join cl on cl.n = x.dst where 1.0/(k+1) >= 0.21""")
def _(s, d):
    return r6(M.markov_clusters(gb(s, d), expansion=5, inflation=3, prune=0.21, singletons=False).edges, "weight")


@query("cluster_mcl_matrix_square")
def _(s, d):
    return M.markov_clusters(gb(s, d), expansion=2, inflation=2, prune=0.01).clusters


@query("cluster_mcl_weighted")
def _(s, d):
    return M.markov_clusters(contacts(s, d), expansion=5, inflation=3, prune=0.11, weight="weight").clusters


_DB = """near as materialized (select a i, b j from s union select x.a, y.b from s x join s y on y.a = x.b union select n, n from v),
 core as materialized (select i from near group by 1 having count(*) >= 4), cl as materialized (select near.i a, near.j b from near join core x on x.i = near.i join core y on y.i = near.j),
 r(n,l) as (select i, i from core union select cl.b, r.l from r join cl on cl.a = r.n where r.l < cl.b), lab as materialized (select n, min(l) l from r group by 1)"""


@query("cluster_dbscan", f"""{rec(base(G_A), CC, _DB.replace('r(n,l)', 'r2(n,l)').replace(' from r join', ' from r2 r join').replace('from r group', 'from r2 group'))} select cc.n as node_id, cc.c as component_id,
 coalesce(lab.l, (select min(l2.l) from near join lab l2 on l2.n = near.j where near.i = cc.n)) as cluster_id, lab.l is not null as core from cc left join lab on lab.n = cc.n""")
def _(s, d):
    return DB.dbscan(ga(s, d), 2, 4)


@query("cluster_dbscan_keys", f"""{rec(base(G_A), CC, _DB.replace('r(n,l)', 'r2(n,l)').replace(' from r join', ' from r2 r join').replace('from r group', 'from r2 group'))} select cc.n as node_id, 'sub_'||cc.c||'_'||coalesce(cast(
 coalesce(lab.l, (select min(l2.l) from near join lab l2 on l2.n = near.j where near.i = cc.n)) as varchar),'-1') as cluster_key from cc left join lab on lab.n = cc.n""")
def _(s, d):
    return DB.cluster_keys(DB.dbscan(ga(s, d), 2, 4))


@query("cluster_hdbscan")
def _(s, d):
    return DB.hdbscan(ga(s, d))


@query("cluster_dpclus")
def _(s, d):
    return S.dpclus(gb(s, d))


@query("dpclus_weights", f"""{rec(base(G_B), CN)} select v.n as node_id, cast(coalesce(sum(w),0) as bigint) as \"W\" from v left join (select u n, w from cn union all select v, w from cn) x on x.n = v.n group by 1""")
def _(s, d):
    return S.density_weights(gb(s, d))[1]


_EAGLE = "ew as materialized (select dg.n, dg.k, ((k+coalesce(t,0))/((k+1)*k/2))*k w from dg left join tn on tn.n = dg.n)"


@query("eagle_weights", f"{rec(base(G_B), TRI, TN, _EAGLE)} select n as node_id, round(w,6) as \"W\", k as deg from ew")
def _(s, d):
    return r6(S.eagle_weights(gb(s, d)), "W")


def _eagle_sql(rounds: int = 8) -> str:
    parts = ["""eq as materialized (select e.u, e.v from e join ew x on x.n = e.u join ew y on y.n = e.v where x.w - y.w = 0), es as materialized (select u a, v b from eq union all select v, u from eq),
 r(n,l) as (select n, n from v union select es.b, r.l from r join es on es.a = r.n where r.l < es.b), g as materialized (select n, min(l) c from r group by 1),
 gi as (select x.c, count(*) k from e join g x on x.n = e.u join g y on y.n = e.v and y.c = x.c group by 1), gn as (select c, count(*) k from g group by 1),
 p0 as materialized (select g.n, g.c from g join gn on gn.c = g.c join gi on gi.c = g.c where gn.k >= 2 and gi.k/(gn.k*(gn.k-1)/2) >= 0.2)"""]
    for i in range(rounds):
        parts.append(f"p{i + 1} as materialized (select x.n, x.c from p{i} x join dg on dg.n = x.n join s on s.a = x.n join p{i} y on y.n = s.b and y.c = x.c group by x.n, x.c, dg.k having count(*)/dg.k >= 0.5)")
    z = f"p{rounds}"
    parts.append(f"zi as (select x.c, count(*) k from e join {z} x on x.n = e.u join {z} y on y.n = e.v and y.c = x.c group by 1), zn as (select c, count(*) k from {z} group by 1)")
    return ", ".join(parts) + f" select x.c as cluster_id, x.n as node_id from {z} x join zi on zi.c = x.c join zn on zn.c = x.c where zn.k >= 2 and zi.k/(zn.k*(zn.k-1)/2) >= 0.2"


@query("cluster_eagle", f"{rec(base(G_A), TRI, TN, _EAGLE)}, {_eagle_sql()}")
def _(s, d):
    return S.eagle(ga(s, d))


@query("cluster_boundary_nodes")
def _(s, d):
    return S.boundary_communities(gb(s, d))


_SIGNED = """with recursive c as materialized ({g}), s as materialized (select u a, v b from c where {keep} union all select v, u from c where {keep}), v as materialized (select u n from c union select v from c),
 r(n,l) using key (n) as (select n, n from v union select s.b, min(q.l) from r q join s on s.a = q.n join recurring.r t on t.n = s.b where q.l < t.l group by s.b), cc as materialized (select n, l c from r)"""


@query("partition_repulsive", _SIGNED.format(g=CONTACTS, keep="weight <= 0") + " select n as node_id, c as component_id from cc")
def _(s, d):
    return P.partition(contacts(s, d), "repulsive")


@query("partition_repulsive_or_zero", _SIGNED.format(g=CONTACTS, keep="weight < 0") + " select n as node_id, c as component_id from cc")
def _(s, d):
    return P.partition(contacts(s, d), "repulsive_or_zero")


@query("partition_threshold_clusters", _SIGNED.format(g=CONTACTS, keep="weight < 0 and abs(weight) > (select quantile_cont(abs(weight), 0.25) from c)")
       + " select c as cluster_id, n as node_id from cc where c in (select c from cc group by 1 having count(*) >= 2)")
def _(s, d):
    return P.partition_clusters(P.partition(contacts(s, d), "threshold", 25))


@query("community_lines", f"{rec(base(G_A), CC)} select string_agg(cast(n as varchar), ' ' order by cast(n as varchar)) as line from cc group by c")
def _(s, d):
    path = scratch_path(s, "cmty")
    S.community_lines(C.connected_components(ga(s, d)), "component_id").write.text(path)
    return s.read.text(path).withColumnRenamed("value", "line")


@query("cluster_store", f"{rec(base(G_B), _mcl_cc(0.21))} select c as cluster_id, n as node_id, 'MCL' as measure, 'e5i3t21' as run_id from cl")
def _(s, d):
    path = scratch_path(s, "runs")
    ST.write_clusters(M.markov_clusters(gb(s, d), expansion=5, inflation=3, prune=0.21, singletons=False).clusters, path, "e5i3t21", "MCL")
    return s.read.parquet(path)


# --- enrichment -------------------------------------------------------------------------------

# Part-level nodes with a mutability bin between edges at mn + i * width, the last bin closed by the maximum.
_PARTS = f"pp as materialized (select pk, node_id, residue_name, total_mutations_count m, avg_am_pathogenicity p, (select count(*) from range(1,5) t(i) where mutability > mn + i*((mx-mn)/5))::int b from ({NODES}) z, (select min(p_retailprice) mn, max(p_retailprice) mx from {{part}}) y)"
_PN = f"{_PARTS}, pn as materialized (select n, pp.* from ({LINE_NODES}) ln join pp on pp.pk = ln.pk)"
_SG = "sr as materialized (select n, residue_name||'_'||b st, m::double x from pn)"


def parts(s, d) -> DataFrame:
    """Parts as residues, with a mutability bin."""
    return EN.equal_width_bins(derive(s, d, NODES), "mutability", "bin_mutability", 5)


def part_nodes(s, d, nodes: str = LINE_NODES) -> DataFrame:
    """Node table keyed like the co-order graph."""
    return parts(s, d).withColumnRenamed("node_id", "residue_id").join(derive(s, d, nodes).withColumnRenamed("n", "node_id"), "pk").drop("pk")


def mcl_clusters(s, d) -> DataFrame:
    return M.markov_clusters(gb(s, d), expansion=5, inflation=3, prune=0.21, singletons=False).clusters


@query("cluster_statistics", f"""{rec(base(G_B), _mcl_cc(0.21), _PN)} select c as cluster_id, count(*) as cluster_size, cast(sum(m) as bigint) as observed_sum, round(avg(m),6) as observed_mean, cast(sum(case when m > 0 then 1 else 0 end) as bigint) as num_mutated_node,
 count(distinct split_part(split_part(pn.node_id,'_',1),'-',1)) as num_unique_uniprot from cl join pn on pn.n = cl.n group by 1""")
def _(s, d):
    n = part_nodes(s, d)
    c = mcl_clusters(s, d).join(n.select("node_id", "residue_id"), "node_id").select("cluster_id", F.col("residue_id").alias("node_id"))
    return r6(G.cluster_statistics(c, parts(s, d)), "observed_mean")


@query("expected_null", f"""{rec(base(G_B), _mcl_cc(0.21), _PN, _SG)}, pl as (select st, count(*) n, avg(x) mu, var_samp(x) s2 from sr group by 1), kk as (select c, st, count(*) k from cl join sr on sr.n = cl.n group by 1, 2)
 select c as cluster_id, cast(sum(k) as bigint) as cluster_size, round(sum(k*mu),6) as expected_sum, round(sum(coalesce(s2,0)*k*(1-k/n)),6)+0.0 as null_variance from kk join pl on pl.st = kk.st group by 1""")
def _(s, d):
    st = G.with_strata(part_nodes(s, d), "total_mutations_count")
    return r6(G.expected_null(mcl_clusters(s, d), st), "expected_sum", "null_variance")


@query("stratum_counts", f"{rec(base(G_B), _mcl_cc(0.21), _PN, _SG)} select c as cluster_id, st as stratum, count(*) as k from cl join sr on sr.n = cl.n group by 1, 2")
def _(s, d):
    return G.stratum_counts(mcl_clusters(s, d), G.with_strata(part_nodes(s, d), "total_mutations_count"))


@query("enriched_clusters", f"""{rec(base(G_B), _mcl_cc(0.21), _PN, _SG)}, pl as (select st, avg(x) mu from sr group by 1)
 select c as cluster_id, count(*) as cluster_size, cast(sum(x) as bigint) as observed_sum, round(sum(mu),6) as expected_sum, round(ln((sum(x)+1e-10)/(sum(mu)+1e-10)),6) as enrichment_score
 from cl join sr on sr.n = cl.n join pl on pl.st = sr.st group by 1 having sum(x) >= 1 order by 5 desc, 1 limit 20""")
def _(s, d):
    n = cut(part_nodes(s, d), "nodes")
    c = mcl_clusters(s, d)
    obs = c.join(n, "node_id").groupBy("cluster_id").agg(F.sum("total_mutations_count").alias("observed_sum"))
    exp = G.expected_null(c, G.with_strata(n, "total_mutations_count"))
    out = exp.join(obs, "cluster_id").where("observed_sum >= 1").select(
        "cluster_id", "cluster_size", "observed_sum", F.round("expected_sum", 6).alias("expected_sum"),
        F.round(G.enrichment_ratio(F.col("observed_sum"), F.col("expected_sum")), 6).alias("enrichment_score"))
    return out.orderBy(F.col("enrichment_score").desc(), "cluster_id").limit(20)


@query("permutation_test_sum")
def _(s, d):
    st = cut(G.with_strata(part_nodes(s, d), "total_mutations_count"), "strata")
    return G.q_values(G.permutation_test(mcl_clusters(s, d), st, n_permutations=10_000, min_sum=1))


@query("permutation_test_mean")
def _(s, d):
    st = cut(G.with_strata(part_nodes(s, d), "avg_am_pathogenicity"), "strata")
    return G.q_values(G.permutation_test(mcl_clusters(s, d), st, n_permutations=10_000, statistic="mean", min_sum=None))


def _log_falling(n: str, t: str) -> str:
    """log(n (n-1) ... (n-t+1)) in SQL."""
    return f"coalesce(list_sum(list_transform(range({t}), lambda i: ln(({n} - i)::double))), 0)"


# Mutated nodes of a cluster among all nodes: the hypergeometric tail.
@query("exact_test_mutated", f"""{rec(base(G_B), _mcl_cc(0.21), _PN)}, f as materialized (select n, case when m > 0 then 1 else 0 end x from pn), al as (select count(*) nn, cast(sum(x) as bigint) mm from f),
 ob as materialized (select c, count(*) k, cast(sum(x) as bigint) o from cl join f on f.n = cl.n group by 1), pr as (select distinct k, o from ob), tm as (select k, o, nn, mm, unnest(range(o, least(k, mm)+1)) j from pr, al),
 tl as (select k, o, sum(exp({_log_falling('k', 'j')} - {_log_falling('j', 'j')} + {_log_falling('mm', 'j')} + {_log_falling('(nn-mm)', '(k-j)')} - {_log_falling('nn', 'k')})) p from tm group by 1, 2)
 select c as cluster_id, ob.k as cluster_size, ob.o as observed_sum, round(ob.k*mm/nn::double,6) as expected_sum, round(least(1, p),6)+0.0 as p_value from ob join tl on tl.k = ob.k and tl.o = ob.o, al""")
def _(s, d):
    n = part_nodes(s, d).withColumn("mutated", (F.col("total_mutations_count") > 0).cast("int"))
    st = cut(G.with_strata(n, "mutated", mode="all"), "strata")
    return r6(ET.exact_test(mcl_clusters(s, d), st, min_sum=None), "expected_sum", "p_value").drop("enrichment_score")


# The null law of the permutation test itself, in place of its draws; tests enumerate it.
@query("exact_test_sum")
def _(s, d):
    st = cut(G.with_strata(part_nodes(s, d), "total_mutations_count"), "strata")
    return G.q_values(ET.exact_test(mcl_clusters(s, d), st, min_sum=1))


@query("q_values", """with p as (select l_partkey as k, round(avg(l_discount)*5,6) as p_value from {lineitem} group by 1), r as (select *, rank() over (order by p_value) + count(*) over (partition by p_value) - 1 as hi, count(*) over () as m from p)
 select k, p_value, round(least(1, min(p_value*m/hi) over (order by p_value desc, k range between unbounded preceding and current row)),6) as q_value from r""")
def _(s, d):
    p = derive(s, d, "select l_partkey as k, round(avg(l_discount)*5,6) as p_value from {lineitem} group by 1")
    return r6(G.q_values(p), "q_value")


@query("significance_report", """with p as (select l_partkey as k, round(avg(l_discount)*5,6) as p_value, count(*) as z from {lineitem} group by 1), r as (select *, rank() over (order by p_value) + count(*) over (partition by p_value) - 1 as hi, count(*) over () as m from p),
 q as (select z, least(1, min(p_value*m/hi) over (order by p_value desc, k range between unbounded preceding and current row)) as q from r)
 select count(*) as n_clusters, cast(sum(case when q < 0.2 then 1 else 0 end) as bigint) as n_significant, round(100.0*sum(case when q < 0.2 then 1 else 0 end)/count(*),1) as percent, cast(coalesce(sum(case when q < 0.2 then z end),0) as bigint) as n_nodes from q""")
def _(s, d):
    p = derive(s, d, "select l_partkey as k, round(avg(l_discount)*5,6) as p_value, count(*) as cluster_size from {lineitem} group by 1")
    return G.significance_report(G.q_values(p), 0.2)


def residue_clusters(s, d) -> DataFrame:
    return mcl_clusters(s, d).join(part_nodes(s, d).select("node_id", "residue_id"), "node_id").select("cluster_id", F.col("residue_id").alias("node_id"))


@query("high_score_nodes", f"{rec(base(G_B), _mcl_cc(0.21), _PN)} select split_part(node_id,'_',1) as chain_id, count(*) as n from cl join pn on pn.n = cl.n where p >= 0.5 group by 1")
def _(s, d):
    return G.high_score_nodes(residue_clusters(s, d), derive(s, d, NODES), threshold=0.5)


@query("protein_frequency", f"{rec(base(G_B), _mcl_cc(0.21), _PN)} select x as name, count(*) as n from (select distinct c, split_part(split_part(node_id,'_',1),'-',1) x from cl join pn on pn.n = cl.n) z group by 1 order by 2 desc, 1 limit 20")
def _(s, d):
    return G.top_n(G.protein_frequency(residue_clusters(s, d)), "n", "name", 20)


@query("clusters_to_draw", f"""{rec(base(G_B), _mcl_cc(0.21), _PN)}, z as (select c, avg(m) o from cl join pn on pn.n = cl.n group by 1 order by round(avg(m),6), c limit 20)
 select z.c as cluster_id, count(distinct split_part(node_id,'_',1)) as n_chains from z join cl on cl.c = z.c join pn on pn.n = cl.n group by 1 having count(distinct split_part(node_id,'_',1)) >= 3""")
def _(s, d):
    c = cut(residue_clusters(s, d), "clusters")
    stat = r6(G.cluster_statistics(c, derive(s, d, NODES)), "observed_mean")
    return G.clusters_to_draw(stat, c, "observed_mean", 20, 3)


@query("contract_by_protein", f"""{rec(base(G_B), _mcl_cc(0.21), _PN)} select distinct x.c as cluster_id, least(split_part(a.node_id,'_',1),split_part(b.node_id,'_',1)) as p, greatest(split_part(a.node_id,'_',1),split_part(b.node_id,'_',1)) as q
 from e join cl x on x.n = e.u join cl y on y.n = e.v and y.c = x.c join pn a on a.n = e.u join pn b on b.n = e.v where split_part(a.node_id,'_',1) <> split_part(b.node_id,'_',1)""")
def _(s, d):
    p = part_nodes(s, d).select("node_id", F.split_part("residue_id", F.lit("_"), F.lit(1)).alias("p"))
    return G.contract_by_protein(mcl_clusters(s, d), gb(s, d).edges, p)


# --- datasets and layers ----------------------------------------------------------------------


@query("split_components", f"""{rec(base(G_A), CC)}, z as (select count(distinct c) n from cc) select 'test' as split, cast(ceil((n-3)*0.2) as bigint) as n from z union all select 'val', cast(ceil((n-3-ceil((n-3)*0.2))*0.125) as bigint) from z
 union all select 'train', cast(n - ceil((n-3)*0.2) - ceil((n-3-ceil((n-3)*0.2))*0.125) as bigint) from z""")
def _(s, d):
    return DS.split_components(C.connected_components(ga(s, d))).groupBy("split").agg(F.count("*").alias("n"))


@query("mutation_flags", f"{rec(base(G_B), CC, _PN)} select c as component_id, count(*) as n_nodes, cast(sum(case when m > 0 then 1 else 0 end) as bigint) as n_mutated, cast(max(case when m > 0 then 1 else 0 end) as int) as mutated from cc left join pn on pn.n = cc.n group by 1")
def _(s, d):
    return DS.mutation_flags(C.connected_components(gb(s, d)), part_nodes(s, d), "total_mutations_count")


def flagged(s, d) -> Graph:
    g = gc(s, d)
    f = part_nodes(s, d, FOLDED_NODES).select("node_id", (F.col("total_mutations_count") > 0).cast("int").alias("is_mut"))
    return Graph(cut(g.vertices.join(f, "node_id"), "vertices"), g.edges)


@query("anchored_balls", f"""{rec(base(G_C), CC_KEYED, _PN.replace(LINE_NODES, FOLDED_NODES))}, z as (select c from cc group by 1 having count(*) >= 100), an as materialized (select cc.n, cc.c from cc join z on z.c = cc.c join pn on pn.n = cc.n where m > 0),
 w(x,n,d) as (select n, n, 0 from an union select w.x, s.b, w.d+1 from w join s on s.a = w.n where w.d < 3), bl as (select distinct x, n from w)
 select an.c as component_id, bl.x as anchor, bl.n as node_id from bl join an on an.n = bl.x where bl.x in (select x from bl group by 1 having count(*) between 4 and 60)""")
def _(s, d):
    return DS.anchored_balls(flagged(s, d), ratio=1.0, max_size=60)


@query("distinct_balls")
def _(s, d):
    g = flagged(s, d)
    return DS.distinct_balls(g, DS.anchored_balls(g, ratio=0.5, max_size=60))


@query("sample_graph_pairs")
def _(s, d):
    flags = DS.mutation_flags(C.connected_components(ga(s, d)), derive(s, d, "select l_orderkey*10+l_partkey%7 as node_id, cast(l_orderkey % 5 = 0 as int) as hit from {lineitem}").groupBy("node_id").agg(F.max("hit").alias("hit")), "hit")
    return DS.sample_pairs(flags.select(F.col("component_id").alias("graph_id"), "mutated"))


@query("sample_neighbours")
def _(s, d):
    g = gb(s, d)
    return DS.sample_neighbours(g, g.vertices, [5, 5, 10])


_X = f"fx as materialized (select n, p_size::double x0, p_retailprice/1000 x1 from ({LINE_NODES}) ln join {{part}} on p_partkey = pk)"


def features(s, d) -> DataFrame:
    return derive(s, d, "select p_partkey as node_id, array(cast(p_size as double), p_retailprice/1000) as x from {part}")


def line_features(s, d) -> DataFrame:
    return derive(s, d, f"select n as node_id, array(cast(p_size as double), p_retailprice/1000) as x from ({LINE_NODES}) ln join {{part}} on p_partkey = pk")


@query("neighbour_mean", f"""{rec(base(G_B))}, fx as materialized (select n, p_size::double x0, round(p_retailprice*100)::double x1 from ({LINE_NODES}) ln join {{part}} on p_partkey = pk)
 select s.a as node_id, round(avg(x0),6) as m0, round(avg(x1),6) as m1 from s join fx on fx.n = s.b group by 1""")
def _(s, d):
    """Sizes and prices in cents are whole, so their sums are exact."""
    g = gb(s, d)
    x = derive(s, d, f"select n as node_id, array(cast(p_size as double), cast(round(p_retailprice*100) as double)) as x from ({LINE_NODES}) ln join {{part}} on p_partkey = pk")
    m = NN.neighbour_mean(g, x.join(g.vertices, "node_id", "left_semi"))
    return m.select("node_id", F.round(F.col("nb")[0], 6).alias("m0"), F.round(F.col("nb")[1], 6).alias("m1"))


_W1, _W2, _B = [[0.1013577, -0.2031711], [0.3071937, 0.4057913]], [[0.5023171, 0.1098673], [-0.3019731, 0.2087137]], [0.0113, -0.0217]


@query("sage_layer", f"""{rec(base(G_B), _X)}, m as (select s.a n, avg(x0) m0, avg(x1) m1 from s join fx on fx.n = s.b group by 1)
 select m.n as node_id, round(greatest(x0*0.1013577+x1*0.3071937+m0*0.5023171-m1*0.3019731+0.0113,0),5) as y0, round(greatest(-x0*0.2031711+x1*0.4057913+m0*0.1098673+m1*0.2087137-0.0217,0),5) as y1 from m join fx on fx.n = m.n""")
def _(s, d):
    g = gb(s, d)
    y = NN.sage_layer(g, line_features(s, d).join(g.vertices, "node_id", "left_semi"), _W1, _W2, _B)
    return y.select("node_id", F.round(F.col("x")[0], 5).alias("y0"), F.round(F.col("x")[1], 5).alias("y1"))


@query("skip_concat_layers")
def _(s, d):
    g = gb(s, d)
    wide = [[0.1, 0.2], [0.0, 0.1], [0.3, -0.1], [0.2, 0.2]]
    return NN.skip_concat(g, line_features(s, d).join(g.vertices, "node_id", "left_semi"), [(_W1, _W2, _B), (wide, wide, _B)])


# Two heads of two outputs each.
_GAT_W = [[[0.3137719, -0.1229317], [0.2217731, 0.4330193]], [[-0.2119751, 0.1739333], [0.3517193, 0.1147319]]]
_GAT_S, _GAT_T, _GAT_B = [[0.4137, -0.3319], [0.2771, 0.5233]], [[-0.2417, 0.3631], [0.1933, -0.2879]], [0.0131713, -0.0217319, 0.0347193, -0.0451731]


def _gat_sql() -> str:
    h = ", ".join(f"(x0/50*{_GAT_W[k][0][o]}+x1*{_GAT_W[k][1][o]}) h{k}{o}" for k in (0, 1) for o in (0, 1))
    st = ", ".join(f"h{k}0*{_GAT_S[k][0]}+h{k}1*{_GAT_S[k][1]} s{k}, h{k}0*{_GAT_T[k][0]}+h{k}1*{_GAT_T[k][1]} t{k}" for k in (0, 1))
    z = ", ".join(f"case when y.s{k}+x.t{k} > 0 then y.s{k}+x.t{k} else 0.2*(y.s{k}+x.t{k}) end z{k}" for k in (0, 1))
    out = ", ".join(f"round(sum(exp(z{k})*h{k}{o})/sum(exp(z{k}))+{_GAT_B[2 * k + o]},5) as y{2 * k + o}" for k in (0, 1) for o in (0, 1))
    return f"""h as materialized (select n, {h} from fx where n in (select n from v)), st as materialized (select *, {st} from h), loops as (select a, b from s union all select n, n from v),
 z as (select x.n, y.h00, y.h01, y.h10, y.h11, {z} from loops join st x on x.n = a join st y on y.n = b) select n as node_id, {out} from z group by n"""


def _four(df: DataFrame) -> DataFrame:
    return df.select("node_id", *[(F.round(F.col("x")[k], 5) + 0.0).alias(f"y{k}") for k in range(4)])


def scaled_features(s, d, nodes: str = LINE_NODES) -> DataFrame:
    return derive(s, d, f"select n as node_id, array(p_size/50.0D, p_retailprice/1000) as x from ({nodes}) ln join {{part}} on p_partkey = pk")


@query("gat_layer", f"{rec(base(G_B), _X)}, {_gat_sql()}")
def _(s, d):
    g = gb(s, d)
    return _four(AT.gat_layer(g, scaled_features(s, d).join(g.vertices, "node_id", "left_semi"), _GAT_W, _GAT_S, _GAT_T, _GAT_B))


@query("gat_layer_hubs", f"{rec(base(G_C), _X.replace(LINE_NODES, FOLDED_NODES))}, {_gat_sql()}")
def _(s, d):
    """The same over the graph with large components."""
    g = gc(s, d)
    return _four(AT.gat_layer(g, scaled_features(s, d, FOLDED_NODES).join(g.vertices, "node_id", "left_semi"), _GAT_W, _GAT_S, _GAT_T, _GAT_B))


_EYE, _NONE = [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0]


@query("cross_attention", f"""{rec(base(G_B), CC, _X)}, gv as materialized (select c, c % 41 bt, count(*) m, avg(x0/50) g0, avg(x1) g1 from cc join fx on fx.n = cc.n group by 1),
 kv as materialized (select bt, m, g0*0.8+g1*0.1+0.05 k0, -g0*0.3+g1*0.6 k1, g0*0.5-g1*0.2 v0, g0*0.4+g1*0.9-0.01 v1 from gv),
 q as (select cc.n, bt, x0/50*1.2+x1*0.3 q0, -x0/50*0.4+x1*0.7+0.02 q1 from cc join fx on fx.n = cc.n join gv on gv.c = cc.c),
 o as (select n, sum(m*exp((q0*k0+q1*k1)/sqrt(2))*v0)/sum(m*exp((q0*k0+q1*k1)/sqrt(2))) o0, sum(m*exp((q0*k0+q1*k1)/sqrt(2))*v1)/sum(m*exp((q0*k0+q1*k1)/sqrt(2))) o1 from q join kv on kv.bt = q.bt group by n),
 w as (select n, (o0-o1)/2 dd from o) select n as node_id, round(dd/sqrt(dd*dd+1e-5),5) as y0, round(-dd/sqrt(dd*dd+1e-5),5) as y1 from w""")
def _(s, d):
    """Nodes attend to the mean vectors of the components of their batch."""
    g = gb(s, d)
    x = scaled_features(s, d).join(C.connected_components(g), "node_id").select("node_id", F.col("component_id").alias("graph_id"), "x")
    vec = NN.mean_readout(x).withColumn("batch", F.pmod("graph_id", F.lit(41)))
    w = AT.AttentionWeights(
        query=([[1.2, -0.4], [0.3, 0.7]], [0.0, 0.02]), key=([[0.8, -0.3], [0.1, 0.6]], [0.05, 0.0]), value=([[0.5, 0.4], [-0.2, 0.9]], [0.0, -0.01]),
        query_in=(_EYE, _NONE), key_in=(_EYE, _NONE), value_in=(_EYE, _NONE), out=(_EYE, _NONE), heads=1)
    y = AT.cross_attention(x, vec, w)
    return y.select("node_id", *[(F.round(F.col("x")[k], 5) + 0.0).alias(f"y{k}") for k in (0, 1)])


@query("attribute_decoder", """with x as (select p_partkey k, p_size/50.0 a, p_retailprice/1000 b from {part}), h as (select k, greatest(a*0.7137719-b*0.4119317+0.1017319, 0) h0, greatest(a*0.2217731+b*0.5330193-0.3117193, 0) h1 from x)
 select k as node_id, round(h0*0.9137719-h1*0.6119317+0.0117319,5) as y0, round(h0*0.3217731+h1*1.1330193,5) as y1 from h""")
def _(s, d):
    x = derive(s, d, "select p_partkey as node_id, array(p_size/50.0D, p_retailprice/1000) as x from {part}")
    y = AT.decode(x, ([[0.7137719, 0.2217731], [-0.4119317, 0.5330193]], [0.1017319, -0.3117193]), ([[0.9137719, 0.3217731], [-0.6119317, 1.1330193]], [0.0117319, 0.0]))
    return y.select("node_id", *[(F.round(F.col("x")[k], 5) + 0.0).alias(f"y{k}") for k in (0, 1)])


@query("infomax_training")
def _(s, d):
    """Losses of two epochs over the components of all lines, one of five held for validation."""
    g = gb(s, d)
    comps = C.connected_components(g).select("node_id", F.col("component_id").alias("graph_id"))
    x = scaled_features(s, d).join(part_nodes(s, d).select("node_id", F.expr("cast(substr(split_part(residue_id, '_', 1), 2, 5) as int) % 200").alias("protein")), "node_id")
    split = F.when(F.pmod(F.xxhash64("graph_id"), F.lit(5)) == 0, "val").otherwise("train")
    nodes = comps.join(x, "node_id").select("graph_id", "node_id", "x", "protein", F.least(F.floor(F.col("x")[1] * 10), F.lit(41)).cast("int").alias("bin"), split.alias("split"))
    edges = g.edges.join(comps.withColumnRenamed("node_id", "u"), "u").select("graph_id", "u", "v")
    c = IM.InfomaxConfig(n_proteins=200, n_bins=42, n_numeric=2, epochs=2, lr=0.01)
    return IM.history(s, IM.train(nodes, edges, c, scratch_path(s, "infomax")))


@query("mean_readout", f"{rec(base(G_B), CC, _X)} select c as graph_id, round(avg(x0),9) as v0, round(avg(x1),9) as v1 from cc join fx on fx.n = cc.n group by 1")
def _(s, d):
    x = C.connected_components(gb(s, d)).join(line_features(s, d), "node_id").withColumnRenamed("component_id", "graph_id")
    return NN.mean_readout(x, width=2).select("graph_id", F.round(F.col("vec")[0], 9).alias("v0"), F.round(F.col("vec")[1], 9).alias("v1"))


@query("bilinear_score", "select p_partkey as node_id, round(p_size*(0.1013577*p_retailprice/1000-0.2031711*p_size)+p_retailprice/1000*(0.3071937*p_retailprice/1000+0.4057913*p_size),4) as score from {part}")
def _(s, d):
    x = features(s, d).withColumn("vec", F.reverse("x"))
    return NN.bilinear_score(x, _W1).select("node_id", F.round("score", 4).alias("score"))


@query("mask_features")
def _(s, d):
    return NN.mask_features(features(s, d), 0.3)


@query("contrastive_loss", """select round(avg(case when p_size % 2 = 1 then dd*dd else pow(greatest(1-dd,0),2) end),6) as contrastive_loss from
 (select p_size, sqrt(pow(p_size/50.0-0.5+1e-6,2)+pow(p_retailprice/2000-0.5+1e-6,2)) as dd from {part}) t""")
def _(s, d):
    p = derive(s, d, "select array(cast(p_size/50.0 as double), p_retailprice/2000) as vec_a, array(0.5D, 0.5D) as vec_b, p_size % 2 as label from {part}")
    return r6(NN.contrastive_loss(p), "contrastive_loss")


@query("classifier_logistic")
def _(s, d):
    x = derive(s, d, "select p_partkey as node_id, array(p_size/50.0D, p_retailprice/2000) as x, cast(p_size > 25 as long) as y from {part}")
    return NN.predict(NN.train_head(x, "logistic", max_iter=20), x).select("node_id", "prediction")


@query("classifier_mlp")
def _(s, d):
    x = derive(s, d, "select p_partkey as node_id, array(p_size/50.0D, p_retailprice/2000) as x, cast(p_size > 25 as long) as y from {part}")
    return NN.predict(NN.train_head(x, "mlp", hidden=(4,), max_iter=20), x).select("node_id", "prediction")


@query("merge_measures", f"{rec(base(G_A), DIST)} select dg.n as node_id, round(k/((select count(*) from v)-1),8) as degree, round(h,6) as closeness_centrality from dg join (select src, sum(case when d > 0 then 1.0/d else 0 end) h from ds group by 1) x on x.src = dg.n")
def _(s, d):
    g = ga(s, d)
    m = N.merge_measures(g.vertices, {"degree": LO.degree_centrality(g), "closeness": D.harmonic(g)}, ["degree", "closeness_centrality"])
    return m.withColumn("degree", F.round("degree", 8)).withColumn("closeness_centrality", F.round("closeness_centrality", 6))


@query("saved_graph_measures", f"select least(u,v) as u, greatest(u,v) as v, weight from ({CONTACTS}) c")
def _(s, d):
    path = scratch_path(s, "graph")
    SG.save_graph(contacts(s, d), path)
    return SG.load_graph(s, path).edges
