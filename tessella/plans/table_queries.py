"""Queries over edge and node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import codons, residues
from tessella.graph import Graph, compose
from tessella.operators import dataset as DS
from tessella.operators import edges as E
from tessella.operators import encode as EN
from tessella.operators import enrichment as G
from tessella.operators import labels as L
from tessella.operators import nodes as N
from tessella.plans.fixtures import CONTACTS, G_B, LINE_NODES, NODES, RAW_EDGES, contact_rows, derive, residue
from tessella.plans.registry import query
from tessella.runtime import cut, scratch_path
from tessella.sources import graphs as SG
from tessella.sources import schemas as SC
from tessella.sources import tables as ST

# --- derived inputs shared by several queries -------------------------------------------------

# Raw contacts with node ids and base proteins.
IDS = f"""select *, lower(replace(uniprot1,'_','-')||'_'||cast(pdb_auth_resi1 as string)||'_'||res3n1) as nodeid_1,
 lower(replace(uniprot2,'_','-')||'_'||cast(pdb_auth_resi2 as string)||'_'||res3n2) as nodeid_2,
 split_part(uniprot1,'_',1) as remove_homo_uniprot1, split_part(uniprot2,'_',1) as remove_homo_uniprot2 from ({RAW_EDGES}) r"""
EDGE_COLS = "uniprot1, pdb_auth_resi1, uniprot2, pdb_auth_resi2, pdb_code, chain_flag, nodeid_1, nodeid_2, cleaned_total_energy"

EXCLUDED = "select distinct upper('x'||cast(s_suppkey % 50 as string)) as \"0\" from {supplier} where s_acctbal < 0"
INCLUDED = "select distinct upper('p'||lpad(cast(p_partkey % 200 as string),5,'0')) as uniprot from {part} where p_size > 10"

# Transcripts: two per protein, with a coding sequence spelled from a digest.
CDS = """select 'ENST'||lpad(cast(k as string),5,'0') as enst,
 translate(md5('a'||cast(k as string))||md5('b'||cast(k as string))||md5('c'||cast(k as string)), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq
 from (select distinct p_partkey % 400 as k from {part}) t"""
XREF = """select distinct upper('p'||lpad(cast(p_partkey % 200 as string),5,'0')) as uniprot_id, 'ENSP'||lpad(cast(p_partkey % 400 as string),5,'0') as ensp from {part}"""
PROTEINS = """select 'ENSP'||lpad(cast(k as string),5,'0') as ensp, 'ENST'||lpad(cast(k as string),5,'0') as enst,
 translate(md5('p'||cast(k as string))||md5('q'||cast(k as string)), '0123456789abcdef', 'ARNDCQEGHILKMFPS') as pseq
 from (select distinct p_partkey % 400 as k from {part}) t"""
# Nodes with positions inside the sequences.
SITES = f"""select 'p'||lpad(cast(l_partkey % 200 as string),5,'0')||case when l_partkey % 10 = 0 then '-2' else '' end||'_'||cast(l_suppkey % 40 as string)||'_'
 ||{residue('l_suppkey')} as node_id
 from {{lineitem}} group by 1"""
_BASE = "substring('ACGT', cast({} as int) % 4 + 1, 1)"
MODEL = f"""select {_BASE.format('floor(c/16)')}||{_BASE.format('floor(c/4)')}||{_BASE.format('c')} as ctx,
 {_BASE.format('floor(c/16)')}||{_BASE.format('floor(c/4)+1+m')}||{_BASE.format('c')} as mut, round(avg(l_discount),6) as freq
 from (select l_partkey % 64 as c, l_suppkey % 3 as m, l_discount from {{lineitem}}) t group by 1, 2"""

COSMIC = """select 'ENST'||lpad(cast(l_partkey % 400 as string),5,'0')||'' as enst_raw, case when l_suppkey % 11 = 0 then null else l_discount*10 end as score,
 case when l_suppkey % 13 = 0 then 'n/a' else 'c.'||cast(l_suppkey % 40 as string)||substring('ACGT', cast(l_partkey % 4 + 1 as int), 1)||'>T' end as cds from {lineitem}"""
MUTAGENE = """select case when l_quantity % 5 = 0 then 'Driver' when l_quantity % 5 = 1 then 'Other' else 'Passenger' end as label,
 case when l_suppkey % 7 = 0 then 'NM_1;X' else 'NM_'||cast(l_suppkey as string)||'; ENST'||lpad(cast(l_partkey % 400 as string),5,'0')||';ENST00000' end as transcripts,
 substring('ARNDC', cast(l_partkey % 5 + 1 as int), 1)||cast(l_suppkey % 40 as string)||'V' as mutation from {lineitem}"""
CHASM = """select 'ENST'||lpad(cast(l_partkey % 400 as string),5,'0') as enst, 'p.'||substring('ARNDC', cast(l_partkey % 5 + 1 as int), 1)||cast(l_suppkey % 40 as string)||'K' as mutation
 from {lineitem}"""


def nodes(s, d) -> DataFrame:
    return derive(s, d, NODES)


def ids(s, d) -> DataFrame:
    return E.add_node_ids(derive(s, d, RAW_EDGES))


def names(s, d, sql: str) -> DataFrame:
    """Fixture whose text quotes a numeric column name."""
    return derive(s, d, sql.replace('"0"', "`0`"))


def cosmic(s, d) -> DataFrame:
    return derive(s, d, COSMIC).toDF("Accession Number", "FATHMM score", "Mutation CDS")


def mutagene(s, d) -> DataFrame:
    return derive(s, d, MUTAGENE).toDF("label", "Transcript ID", "mutation")


def chasmplus(s, d) -> DataFrame:
    return derive(s, d, CHASM).toDF("Transcript ID", "mutation")


def model(s, d) -> DataFrame:
    return derive(s, d, MODEL)


def contexts(s, d) -> DataFrame:
    return N.node_contexts(derive(s, d, SITES), derive(s, d, XREF), derive(s, d, PROTEINS), derive(s, d, CDS))


# --- sources ----------------------------------------------------------------------------------


@query("scan_csv_edges", f"select uniprot1, pdb_auth_resi1, res3n1, uniprot2, pdb_auth_resi2, res3n2, pdb_code, chain_flag, cleaned_total_energy from ({RAW_EDGES}) r")
def _(s, d):
    path = scratch_path(s, "csv")
    derive(s, d, RAW_EDGES).write.option("header", "true").csv(path)
    cols = "uniprot1 pdb_auth_resi1 res3n1 uniprot2 pdb_auth_resi2 res3n2 pdb_code chain_flag cleaned_total_energy".split()
    return ST.read_csv(s, path, SC.CONTACT_EDGES).select(*[F.col(c).cast("long") if "resi" in c else F.col(c) for c in cols])


@query("scan_gzip_tsv", f"select enst_raw as accession, round(score,6) as score, cds from ({COSMIC}) c")
def _(s, d):
    path = scratch_path(s, "tsv")
    cosmic(s, d).write.option("header", "true").option("sep", "\t").option("compression", "gzip").csv(path)
    return ST.read_csv(s, path, SC.COSMIC, sep="\t").select(
        F.col("Accession Number").alias("accession"), F.round("FATHMM score", 6).alias("score"), F.col("Mutation CDS").alias("cds"))


@query("scan_json_model", f"select ctx, mut, freq from ({MODEL}) m")
def _(s, d):
    path = scratch_path(s, "json")
    # At most 64 contexts with three changes each.
    inner = model(s, d).groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("mut", "freq"))).alias("m"))
    one = inner.agg(F.to_json(F.create_map(F.lit("33999"), F.map_from_entries(F.collect_list(F.struct("ctx", "m"))))).alias("value"))
    one.write.text(path)
    return ST.read_substitution_model(s, path, key="33999")


@query("scan_or_create_label_map", """select s, cast(row_number() over (order by s) as int) as idx from (select distinct p_brand as s from {part}) t
 union all select 'Unknown', 0""")
def _(s, d):
    path = scratch_path(s, "labels")
    part = derive(s, d, "select * from {part}")
    ST.label_map(part, "p_brand", path)
    return ST.label_map(part, "p_brand", path).select(F.col("label").alias("s"), "idx")


@query("graph_save_load", G_B)
def _(s, d):
    path = scratch_path(s, "graph")
    SG.save_graph(Graph.from_edges(derive(s, d, G_B)), path)
    return SG.load_graph(s, path).edges


_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query("scan_fasta", f"select case when doc_id % 2 = 0 then 'Q'||cast(doc_id as string) else 'D'||cast(doc_id as string) end as id, length({_SEQ}) as n, md5({_SEQ}) as digest from {{documents}}")
def _(s, d):
    path = scratch_path(s, "fasta")
    docs = derive(s, d, "select * from {documents}")
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(">sp|Q"), F.col("doc_id").cast("string"), F.lit("|A B"))).otherwise(
        F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit(" note")))
    wrapped = F.regexp_replace(seq, "(.{60})", "$1\n")
    docs.select(F.concat(head, F.lit("\n"), wrapped).alias("value")).write.text(path)
    return SG.read_fasta(s, path).select("id", F.length("sequence").alias("n"), F.md5("sequence").alias("digest"))


def _jobs_sql(words: str) -> str:
    return f"""select id, {words} as command from (select distinct 'D'||cast(doc_id as string) as id from {{documents}}) t
 where id not in (select 'D'||cast(doc_id as string) from {{labels}} where quality = 1)"""


def _jobs(s, d, tool):
    docs = derive(s, d, "select 'D'||cast(doc_id as string) as id from {documents}")
    done = derive(s, d, "select 'D'||cast(doc_id as string) as id from {labels} where quality = 1")
    return SG.open_jobs(docs, done, tool, "fa", "db", "out").select("id", F.array_join("command", " ").alias("command"))


@query("open_pssm_jobs", _jobs_sql("'psiblast -query fa/'||id||'.fasta -db db/nr -num_iterations 3 -evalue 0.001 -matrix BLOSUM62 -out_ascii_pssm out/'||id||'.pssm'"))
def _(s, d):
    return _jobs(s, d, "pssm")


@query("open_hhm_jobs", _jobs_sql("'hhblits -i fa/'||id||'.fasta -d db/UniRef30_2023_02 -ohhm out/'||id||'.hhm -cpu 1 -n 2 -v 0'"))
def _(s, d):
    return _jobs(s, d, "hhm")


@query("lookup_gene_names", f"""select node_id, coalesce(nm.s_name, n.uniprot_id) as gene_name from (select node_id, split_part(split_part(node_id,'_',1),'-',1) as uniprot_id from ({NODES}) x) n
 left join (select 'p'||lpad(cast(s_suppkey as string),5,'0') as uniprot_id, min(s_name) as s_name from {{supplier}} where s_suppkey % 3 = 0 group by 1) nm on nm.uniprot_id = n.uniprot_id""")
def _(s, d):
    gene = derive(s, d, "select 'p'||lpad(cast(s_suppkey as string),5,'0') as uniprot_id, min(s_name) as gene_name from {supplier} where s_suppkey % 3 = 0 group by 1")
    return ST.lookup_names(N.with_id_parts(nodes(s, d)), gene, "uniprot_id", "gene_name").select("node_id", "gene_name")


@query("scan_pajek", f"select u, v, weight from ({CONTACTS}) c")
def _(s, d):
    path = scratch_path(s, "pajek")
    g = Graph.from_edges(contact_rows(s, d), attrs=("weight",))
    SG.write_pajek(g, path)
    return SG.read_pajek(s, path).edges


@query("scan_weighted_edge_list", f"select u, v, weight from ({CONTACTS}) c")
def _(s, d):
    path = scratch_path(s, "dat")
    contact_rows(s, d).select(F.concat_ws(" ", "u", "v", F.col("weight").cast("string")).alias("value")).write.text(path)
    return SG.read_weighted_edges(s, path).edges


@query("scan_gml", f"select u, v from ({G_B}) e")
def _(s, d):
    path = scratch_path(s, "gml")
    g = Graph.from_edges(derive(s, d, G_B))
    node = g.vertices.select(F.format_string("  node [ id %d label \"n\" ]", "node_id").alias("value"))
    edge = g.edges.select(F.format_string("  edge [ source %d target %d ]", "u", "v").alias("value"))
    node.unionAll(edge).write.text(path)
    return SG.read_gml(s, path).edges.select("u", "v")


@query("graph_from_edge_list", f"select node_id, count(*) as deg from (select u as node_id from ({CONTACTS}) c union all select v from ({CONTACTS}) c) t group by 1")
def _(s, d):
    g = Graph.from_edges(contact_rows(s, d), attrs=("weight",))
    return g.degrees().where("deg > 0")


@query("upsert_results", """select coalesce(n.k, o.k) as \"Measure\", coalesce(n.v, o.v) as \"Value\" from (select p_brand as k, round(avg(p_retailprice),4) as v from {part} group by 1) o
 full join (select p_brand as k, round(max(p_retailprice),4) as v from {part} where p_size > 40 group by 1) n on n.k = o.k""")
def _(s, d):
    old = derive(s, d, "select p_brand as Measure, round(avg(p_retailprice),4) as Value from {part} group by 1")
    new = derive(s, d, "select p_brand as Measure, round(max(p_retailprice),4) as Value from {part} where p_size > 40 group by 1")
    return ST.upsert_results(old, new)


# --- projections and filters ------------------------------------------------------------------


@query("filter_listed_proteins", f"""select {EDGE_COLS} from ({IDS}) i where not exists (select 1 from ({EXCLUDED}) x where lower(x."0") = i.pdb_code)
 and remove_homo_uniprot1 in (select lower(uniprot) from ({INCLUDED}) y) and remove_homo_uniprot2 in (select lower(uniprot) from ({INCLUDED}) y)""")
def _(s, d):
    return E.keep_listed_proteins(ids(s, d), names(s, d, EXCLUDED), derive(s, d, INCLUDED)).selectExpr(*EDGE_COLS.split(", "))


@query("filter_blocked_proteins", f"select {EDGE_COLS} from ({IDS}) i where uniprot1 not in ('p00007','p00011','p00047_') and uniprot2 not in ('p00007','p00011','p00047_')")
def _(s, d):
    return E.drop_blocked_proteins(ids(s, d), ["p00007", "p00011", "p00047_"]).selectExpr(*EDGE_COLS.split(", "))


@query("project_node_ids", f"select {EDGE_COLS}, remove_homo_uniprot1, remove_homo_uniprot2 from ({IDS}) i")
def _(s, d):
    return ids(s, d).selectExpr(*EDGE_COLS.split(", "), "remove_homo_uniprot1", "remove_homo_uniprot2")


@query("filter_applicable_nodes", f"""select {EDGE_COLS} from ({IDS}) i where nodeid_1 in (select node_id from ({NODES}) n where total_mutations_count > 0 or dssp_phi > 0)
 and nodeid_2 in (select node_id from ({NODES}) n where total_mutations_count > 0 or dssp_phi > 0)""")
def _(s, d):
    return E.keep_listed_nodes(ids(s, d), nodes(s, d).where("total_mutations_count > 0 or dssp_phi > 0")).selectExpr(*EDGE_COLS.split(", "))


@query("filter_positive_positions", f"select {EDGE_COLS} from ({IDS}) i where pdb_auth_resi1 > 0 and pdb_auth_resi2 > 0")
def _(s, d):
    return E.keep_positive_positions(ids(s, d)).selectExpr(*EDGE_COLS.split(", "))


@query("filter_inter_chain", f"select {EDGE_COLS} from ({IDS}) i where chain_flag = 'inter-chain' and remove_homo_uniprot1 <> remove_homo_uniprot2")
def _(s, d):
    return E.keep_inter_chain(ids(s, d)).selectExpr(*EDGE_COLS.split(", "))


@query("filter_homodimer_copies", f"select {EDGE_COLS} from ({IDS}) i where not contains(nodeid_1, '-') and not contains(nodeid_2, '-')")
def _(s, d):
    return E.drop_homodimer_copies(ids(s, d)).selectExpr(*EDGE_COLS.split(", "))


@query("filter_missing_energy", f"select {EDGE_COLS} from ({IDS}) i where cleaned_total_energy is not null")
def _(s, d):
    return E.drop_missing_energy(ids(s, d)).selectExpr(*EDGE_COLS.split(", "))


@query("unique_endpoints", f"select nodeid_1 as node_id from ({IDS}) i union select nodeid_2 from ({IDS}) i")
def _(s, d):
    return E.unique_endpoints(ids(s, d))


@query("project_id_parts", f"""select node_id, split_part(node_id,'_',2) as position, split_part(node_id,'_',3) as "residueType", split_part(split_part(node_id,'_',1),'-',1) as uniprot_id,
 nullif(split_part(split_part(node_id,'_',1),'-',2),'') as copyindex from ({NODES}) n""")
def _(s, d):
    return N.with_id_parts(nodes(s, d)).select("node_id", "position", "residueType", "uniprot_id", "copyindex")


@query("filter_repulsive_edges", f"select u, v, weight from ({CONTACTS}) c where weight <= 0")
def _(s, d):
    return E.drop_repulsive(contact_rows(s, d))


@query("filter_repulsive_or_zero_edges", f"select u, v, weight from ({CONTACTS}) c where weight < 0")
def _(s, d):
    return E.drop_repulsive(contact_rows(s, d), with_zero=True)


@query("filter_weak_edges", f"with c as materialized ({CONTACTS}) select u, v, weight from c where abs(weight) > (select quantile_cont(abs(weight), 0.25) from c) and weight < 0")
def _(s, d):
    return E.drop_weak_or_repulsive(contact_rows(s, d), 25)


@query("filter_score", f"select node_id, avg_am_pathogenicity from ({NODES}) n where avg_am_pathogenicity >= 0.5")
def _(s, d):
    return nodes(s, d).where("avg_am_pathogenicity >= 0.5").select("node_id", "avg_am_pathogenicity")


@query("filter_copy_nodes", f"select node_id from ({NODES}) n where contains(node_id, '-')")
def _(s, d):
    return nodes(s, d).where(F.col("node_id").contains("-")).select("node_id")


# --- joins ------------------------------------------------------------------------------------


@query("join_feature_tables", f"""select n.node_id, round(n.mutability,4) as mutability_x, m.mutability as mutability_y, k.deg from ({NODES}) n
 left join (select node_id, total_mutations_count as mutability from ({NODES}) a where dssp_phi > 0) m on m.node_id = n.node_id
 left join (select u as node_id, count(*) as deg from ({CONTACTS}) c group by 1) k on k.node_id = n.node_id""")
def _(s, d):
    n = nodes(s, d)
    m = n.where("dssp_phi > 0").select("node_id", F.col("total_mutations_count").alias("mutability"))
    k = contact_rows(s, d).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("deg"))
    return N.join_features(n.select("node_id", "mutability"), m, k).select("node_id", F.round("mutability_x", 4).alias("mutability_x"), "mutability_y", "deg")


@query("join_missing_features", f"select node_id from ({NODES}) n where node_id not in (select u from ({CONTACTS}) c) and node_id not in (select v from ({CONTACTS}) c)")
def _(s, d):
    return nodes(s, d).select("node_id").join(E.unique_endpoints(contact_rows(s, d).toDF("nodeid_1", "nodeid_2", "w")), "node_id", "left_anti")


@query("join_attribute_mapping", f"""select g.node_id, coalesce(n.total_mutations_count, 0) as total_mutations_count, cast(case when n.total_mutations_count <> 0 then 1 else 0 end as int) as has_mutation
 from (select u as node_id from ({CONTACTS}) c union select v from ({CONTACTS}) c) g left join (select * from ({NODES}) x where dssp_phi > -100) n on n.node_id = g.node_id""")
def _(s, d):
    g = Graph.from_edges(contact_rows(s, d), attrs=("weight",))
    return N.map_attributes(g, nodes(s, d).where("dssp_phi > -100"), ["total_mutations_count"])


@query("join_count_alignment", """select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right from (select l_partkey as k, count(*) as n from {lineitem} where l_returnflag = 'R' group by 1) a
 full join (select l_partkey as k, count(*) as n from {lineitem} where l_quantity >= 40 group by 1) b on a.k = b.k""")
def _(s, d):
    a = derive(s, d, "select l_partkey as k, count(*) as n from {lineitem} where l_returnflag = 'R' group by 1")
    b = derive(s, d, "select l_partkey as k, count(*) as n from {lineitem} where l_quantity >= 40 group by 1")
    return N.align_counts(a, b, "k")


@query("join_induced_subgraph", f"""with k as (select n from ({LINE_NODES}) ln join {{part}} on p_partkey = pk where p_size > 20)
 select u, v from ({G_B}) e where u in (select n from k) and v in (select n from k)""")
def _(s, d):
    keep = derive(s, d, f"select n as node_id from ({LINE_NODES}) ln join {{part}} on p_partkey = pk where p_size > 20")
    return Graph.from_edges(derive(s, d, G_B)).induced(keep).edges


@query("graph_composition", f"""with c as materialized ({CONTACTS}), n as materialized (select u n from c union select v from c),
 x as (select n, length(n) a, cast(null as bigint) b from n), y as (select n, case when length(n) % 2 = 0 then 2*length(n) end a, length(n) b from n where n < 'p00100'),
 z as (select n, case when length(n) % 3 = 0 then -1 end a, cast(null as bigint) b from n where n > 'p00050')
 select x.n as node_id, coalesce(z.a, y.a, x.a) as a, y.b as b from x left join y on y.n = x.n left join z on z.n = x.n""")
def _(s, d):
    """Later graphs win where they have a value; the third lacks ``b``."""
    g = Graph.from_edges(contact_rows(s, d), attrs=("weight",))
    g = Graph(cut(g.vertices, "vertices"), g.edges)  # the edges are written already
    size = F.length("node_id")
    x = g.vertices.select("node_id", size.alias("a"))
    y = g.vertices.where("node_id < 'p00100'").select("node_id", F.when(size % 2 == 0, 2 * size).alias("a"), size.alias("b"))
    z = g.vertices.where("node_id > 'p00050'").select("node_id", F.when(size % 3 == 0, -1).alias("a"))
    return compose([Graph(x, g.edges), Graph(y, g.edges.select("u", "v")), Graph(z, g.edges.limit(0))]).vertices


@query("graph_composition_edges", f"""with c as materialized ({CONTACTS}), y as (select u, v, -weight w from c where weight < 0), z as (select u, v, 1.5 w, 1 late from c where weight > 3)
 select c.u, c.v, round(coalesce(z.w, y.w, c.weight),6) as w, z.late as late from c left join y on y.u = c.u and y.v = c.v left join z on z.u = c.u and z.v = c.v""")
def _(s, d):
    g = Graph.from_edges(contact_rows(s, d), attrs=("weight",))
    y = g.edges.where("weight < 0").select("u", "v", (-F.col("weight")).alias("w"))
    z = g.edges.where("weight > 3").select("u", "v", F.lit(1.5).alias("w"), F.lit(1).alias("late"))
    parts = [Graph(g.vertices, e) for e in (g.edges.withColumnRenamed("weight", "w"), y, z)]
    return compose(parts).edges.withColumn("w", F.round("w", 6) + 0.0)


@query("node_codon_contexts", f"""with p as (select node_id, upper(regexp_replace(split_part(node_id,'_',1), '-\\d+$', '')) as uniprot_id, cast(split_part(node_id,'_',2) as int) as pos,
  substring('ARNDCQEGHILKMFPSTWYV', (strpos('alaargasnaspcysglngluglyhisileleulysmetpheproserthrtrptyrval', split_part(node_id,'_',3)) + 2) // 3, 1) as aa from ({SITES}) s),
 h as (select distinct p.node_id, p.pos, pr.enst from p join ({XREF}) x on x.uniprot_id = p.uniprot_id join ({PROTEINS}) pr on pr.ensp = x.ensp where p.pos > 0 and p.pos <= length(pseq) and substring(pseq, p.pos, 1) = p.aa),
 c as (select node_id, h.enst, case when pos > 1 and (pos-1)*3+4 <= length(seq) then substring(seq, (pos-1)*3, 5) end as ctx from h left join ({CDS}) d on d.enst = h.enst)
 select p.node_id, string_agg(c.enst, ',' order by c.enst) as ensmbl, string_agg(case when c.enst is not null then coalesce(ctx,'-') end, ',' order by c.enst) as ctxs from p left join c on c.node_id = p.node_id group by 1""")
def _(s, d):
    c = contexts(s, d)
    return c.select("node_id", F.array_join("ensmbl_id", ",").alias("ensmbl"), F.array_join("cds_contexts", ",", "-").alias("ctxs"))


_AA = "substring('KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV_Y_YSSSS_CWCLFLF', (strpos('ACGT', substring({c},1,1))-1)*16+(strpos('ACGT', substring({c},2,1))-1)*4+strpos('ACGT', substring({c},3,1)), 1)"


def _score_sql(source: str) -> str:
    """Score of every distinct context of ``source(ctx)``; bases in ACGT order."""
    turn = []
    for k in (1, 2, 3):
        new = f"substring(c.ctx,2,{k - 1})||substring(m.mut,2,1)||substring(c.ctx,{k + 2},{3 - k})"
        turn.append(f"select c.ctx, case when {_AA.format(c=f'({new})')} <> {_AA.format(c='substring(c.ctx,2,3)')} then m.freq else 0 end as f from dc c join md m on m.ctx = substring(c.ctx,{k},3)")
    return f"dc as (select distinct ctx from {source} where ctx is not null), md as ({MODEL}), sc as (select ctx, sum(f) as score from ({' union all '.join(turn)}) t group by 1)"


_CTX = f"""p as (select node_id, upper(regexp_replace(split_part(node_id,'_',1), '-\\d+$', '')) as uniprot_id, cast(split_part(node_id,'_',2) as int) as pos,
  substring('ARNDCQEGHILKMFPSTWYV', (strpos('alaargasnaspcysglngluglyhisileleulysmetpheproserthrtrptyrval', split_part(node_id,'_',3)) + 2) // 3, 1) as aa from ({SITES}) s),
 h as (select distinct p.node_id, p.pos, pr.enst from p join ({XREF}) x on x.uniprot_id = p.uniprot_id join ({PROTEINS}) pr on pr.ensp = x.ensp where p.pos > 0 and p.pos <= length(pseq) and substring(pseq, p.pos, 1) = p.aa),
 cx as (select node_id, h.enst, case when pos > 1 and (pos-1)*3+4 <= length(seq) then substring(seq, (pos-1)*3, 5) end as ctx from h left join ({CDS}) d on d.enst = h.enst)"""


@query("node_mutability", f"""with {_CTX}, {_score_sql('cx')}, t as (select node_id, count(*) as total, count(ctx) as known from cx group by 1)
 select p.node_id, case when t.known > 0 then round(coalesce(x.m, 0), 9) end as mutability from p left join t on t.node_id = p.node_id
 left join (select cx.node_id, sum(coalesce(score,0)) / max(total) as m from cx join t on t.node_id = cx.node_id left join sc on sc.ctx = cx.ctx where cx.ctx is not null group by 1) x on x.node_id = p.node_id""")
def _(s, d):
    return N.mutability(contexts(s, d), model(s, d)).select("node_id", F.round("mutability", 9).alias("mutability"))


@query("context_scores", f"""with q as (select distinct substring(seq, k*3, 5) as ctx from ({CDS}) c, (select unnest(range(1, 29)) as k) n), {_score_sql('q')}
 select dc.ctx as context, round(coalesce(score,0),6) as score from dc left join sc on sc.ctx = dc.ctx""")
def _(s, d):
    seqs = derive(s, d, CDS).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(28))))
    ctx = seqs.select(F.substring(F.col("seq"), F.col("k") * 3, F.lit(5)).alias("context"))
    return codons.context_scores(ctx, model(s, d)).select("context", F.round("score", 6).alias("score"))


@query("translate_codons", f"select enst, k, {_AA.format(c='substring(seq, k*3+1, 3)')} as aa from ({CDS}) c, (select unnest(range(0, 30)) as k) n")
def _(s, d):
    seqs = derive(s, d, CDS).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return seqs.select("enst", "k", codons.translate_codon(F.substring(F.col("seq"), F.col("k") * 3 + 1, F.lit(3))).alias("aa"))


@query("parse_node_ids", f"""select node_id, upper(regexp_replace(lower(split_part(node_id,'_',1)), '-\\d+$', '')) as uniprot_id, cast(split_part(node_id,'_',2) as int) as position,
  substring('ARNDCQEGHILKMFPSTWYV', (strpos('alaargasnaspcysglngluglyhisileleulysmetpheproserthrtrptyrval', split_part(node_id,'_',3)) + 2) // 3, 1) as aa1 from ({NODES}) n""")
def _(s, d):
    return nodes(s, d).select("node_id", residues.parse_node_id(F.col("node_id")).alias("p")).select("node_id", "p.*")


@query("parse_list_literals", f"select node_id, coalesce(replace(replace(replace(replace(ptms_mapped,'[',''),']',''),'''',''),' ',''),'') as items from ({NODES}) n")
def _(s, d):
    return nodes(s, d).select("node_id", F.array_join(residues.parse_list(F.col("ptms_mapped")), ",").alias("items"))


# --- labels -----------------------------------------------------------------------------------

_ONE3 = "lower(substring('ALAARGASNASPCYSTHRGLY', (strpos('ARNDCTG', {r})-1)*3+1, 3))"
_COSMIC_S = f"""select enst_raw as enst, cast(regexp_extract(cds,'c.(\\d+)([A-Z])',1) as int) as pos, {_ONE3.format(r="regexp_extract(cds,'c.(\\d+)([A-Z])',2)")} as res,
 cast(max(case when score > 0.8 then 1 else 0 end) as int) as is_driver from ({COSMIC}) c where score is not null and regexp_matches(cds,'c.(\\d+)([A-Z])') group by 1,2,3"""
_MUTA_S = f"""select trim(split_part(transcripts,';',2)) as enst, cast(regexp_extract(mutation,'([A-Z])(\\d+)',2) as int) as pos, {_ONE3.format(r="regexp_extract(mutation,'([A-Z])(\\d+)',1)")} as res,
 cast(max(case when label='Driver' then 1 else 0 end) as int) as is_driver from ({MUTAGENE}) m where label in ('Driver','Passenger') and contains(transcripts,'ENST') group by 1,2,3"""
_CHASM_S = f"""select enst, cast(regexp_extract(mutation,'p\\.([A-Z])(\\d+)',2) as int) as pos, {_ONE3.format(r="regexp_extract(mutation,'p\\.([A-Z])(\\d+)',1)")} as res, cast(1 as int) as is_driver from ({CHASM}) c group by 1,2,3"""


@query("labels_cosmic", _COSMIC_S)
def _(s, d):
    return L.cosmic_status(cosmic(s, d), 80)


@query("labels_mutagene", _MUTA_S)
def _(s, d):
    return L.mutagene_status(mutagene(s, d))


@query("labels_chasmplus", _CHASM_S)
def _(s, d):
    return L.chasmplus_status(chasmplus(s, d))


@query("labels_merged", f"select enst, pos, res, round(avg(is_driver),6) as status from (({_COSMIC_S}) union all ({_MUTA_S}) union all ({_CHASM_S})) t group by 1,2,3")
def _(s, d):
    merged = L.merge_status(L.cosmic_status(cosmic(s, d), 0.8), L.mutagene_status(mutagene(s, d)), L.chasmplus_status(chasmplus(s, d)))
    return merged.select("enst", "pos", "res", F.round("status", 6).alias("status"))


_LABEL_NODES = """select node_id, split_part(node_id,'_',2) as position, split_part(node_id,'_',3) as residue, cast(substring(node_id,2,5) as int) as k from ({sites}) s"""


@query("join_driver_status", f"""with n as ({_LABEL_NODES.replace('{sites}', SITES)}), st as (select enst, pos, res, avg(is_driver) as status from (({_COSMIC_S}) union all ({_MUTA_S}) union all ({_CHASM_S})) t group by 1,2,3),
 l as (select node_id, cast(position as int) as pos, residue, 'ENST'||lpad(cast(k as string),5,'0') as enst from n union select node_id, cast(position as int), residue, 'ENST'||lpad(cast(k+200 as string),5,'0') from n)
 select l.node_id, cast(max(case when status > 0 then 1 else 0 end) as int) as is_driver from l join st on st.enst = l.enst and st.pos = l.pos and st.res = l.residue group by 1""")
def _(s, d):
    merged = L.merge_status(L.cosmic_status(cosmic(s, d), 0.8), L.mutagene_status(mutagene(s, d)), L.chasmplus_status(chasmplus(s, d)))
    n = derive(s, d, _LABEL_NODES.replace("{sites}", SITES)).selectExpr(
        "node_id", "position", "residue as residueType",
        "array('ENST'||lpad(cast(k as string),5,'0')||'.2', 'ENST'||lpad(cast(k+200 as string),5,'0')) as ensmbl_id")
    return L.map_driver_status(n, merged).select("node_id", "is_driver")


@query("labels_union_distinct", f"""select enst, pos, res, is_driver from (({_COSMIC_S}) union ({_MUTA_S}) union ({_CHASM_S})) t""")
def _(s, d):
    return L.combine_labelled(L.cosmic_status(cosmic(s, d), 0.8), L.mutagene_status(mutagene(s, d)), L.chasmplus_status(chasmplus(s, d)), keys=("enst", "pos", "res", "is_driver"))


# --- aggregations -----------------------------------------------------------------------------


@query("merge_symmetric_edges", f"""select least(nodeid_1,nodeid_2) as nodeid_1, greatest(nodeid_1,nodeid_2) as nodeid_2, arg_min(pdb_code, chain_flag||'|'||pdb_code) as pdb_code, min(chain_flag) as chain_flag,
 round(avg(cleaned_total_energy),6)+0.0 as cleaned_total_energy from ({IDS}) i group by 1, 2 having avg(cleaned_total_energy) is not null""")
def _(s, d):
    cols = ["nodeid_1", "nodeid_2", "pdb_code", "chain_flag", "cleaned_total_energy"]
    return E.merge_symmetric(ids(s, d).select(*cols), ["chain_flag", "pdb_code"]).withColumn("cleaned_total_energy", F.round("cleaned_total_energy", 6) + 0.0)


@query("dedupe_edges", f"select nodeid_1, nodeid_2, min(pdb_code) as pdb_code from ({IDS}) i group by 1, 2")
def _(s, d):
    return E.dedupe_first(ids(s, d).select("nodeid_1", "nodeid_2", "pdb_code"), ["nodeid_1", "nodeid_2"])


@query("table_overview", f"""select count(*) as n_nodes, count(distinct split_part(split_part(node_id,'_',1),'-',1)) as n_proteins, sum(case when contains(node_id,'-') then 1 else 0 end)::bigint as n_copies,
 round(100.0*sum(case when total_mutations_count > 0 then 1 else 0 end)/count(*),2) as percent_mutated from ({NODES}) n""")
def _(s, d):
    n = N.with_id_parts(nodes(s, d))
    return n.agg(F.count("*").alias("n_nodes"), F.count_distinct("uniprot_id").alias("n_proteins"), F.sum(F.col("node_id").contains("-").cast("long")).alias("n_copies"),
                 F.round(100.0 * F.sum((F.col("total_mutations_count") > 0).cast("long")) / F.count("*"), 2).alias("percent_mutated"))


@query("element_counts", f"""select x, count(*) as n from (select unnest(string_split(replace(replace(replace(replace(ptms_mapped,'[',''),']',''),'''',''),' ',''),',')) as x from ({NODES}) n where ptms_mapped <> '[]') t group by 1""")
def _(s, d):
    return nodes(s, d).select(F.explode(residues.parse_list(F.col("ptms_mapped"))).alias("x")).groupBy("x").agg(F.count("*").alias("n"))


@query("copy_numbers", f"select split_part(split_part(node_id,'_',1),'-',1) as uniprot_id, cast(coalesce(max(cast(nullif(split_part(split_part(node_id,'_',1),'-',2),'') as int)),0)+1 as int) as copy_num from ({NODES}) n group by 1")
def _(s, d):
    return N.copy_numbers(N.with_id_parts(nodes(s, d)))


@query("copy_numbers_folded", f"""with c as (select distinct split_part(split_part(node_id,'_',1),'-',1) as p, cast(nullif(split_part(split_part(node_id,'_',1),'-',2),'') as int) as k from ({NODES}) n),
 r as (select p, list_sort(list(k) filter (where k is not null)) as ks from c group by 1)
 select p as uniprot_id, cast(case when ks is null or len(ks) = 0 then 1 else list_reduce(ks[2:], lambda a, x: case when x > a then x + 1 else a end, ks[1] + 1) end as int) as copy_num from r""")
def _(s, d):
    return N.copy_numbers(N.with_id_parts(nodes(s, d)), parity=True)


_COPY = f"select split_part(split_part(node_id,'_',1),'-',1) as uniprot_id, coalesce(max(cast(nullif(split_part(split_part(node_id,'_',1),'-',2),'') as int)),0)+1 as copy_num, count(*) as raw_total, sum(case when total_mutations_count>0 then 1 else 0 end)::bigint as raw_mut from ({NODES}) n group by 1"


@query("normalized_counts", f"select uniprot_id, raw_total, raw_mut, round(raw_total/copy_num,6) as norm_total, round(raw_mut/copy_num,6) as norm_mut from ({_COPY}) c")
def _(s, d):
    n = N.with_id_parts(nodes(s, d)).withColumn("is_mut", (F.col("total_mutations_count") > 0).cast("int"))
    return N.normalized_counts(n, N.copy_numbers(n)).select("uniprot_id", "raw_total", "raw_mut", F.round("norm_total", 6).alias("norm_total"), F.round("norm_mut", 6).alias("norm_mut"))


@query("top_proteins", f"select uniprot_id, round(raw_mut/copy_num,6) as norm_mut from ({_COPY}) c order by 2 desc, 1 limit 50")
def _(s, d):
    n = N.with_id_parts(nodes(s, d)).withColumn("is_mut", (F.col("total_mutations_count") > 0).cast("int"))
    return G.top_n(N.normalized_counts(n, N.copy_numbers(n)).select("uniprot_id", F.round("norm_mut", 6).alias("norm_mut")), "norm_mut", "uniprot_id", 50)


@query("normalize_minmax", f"with n as materialized ({NODES}) select node_id, round((mutability-(select min(mutability) from n))/((select max(mutability) from n)-(select min(mutability) from n)),6) as mutability from n")
def _(s, d):
    return N.normalize(nodes(s, d).select("node_id", "mutability"), ["mutability"]).select("node_id", F.round("mutability", 6).alias("mutability"))


@query("normalize_zscore", f"with n as materialized (select node_id, coalesce(avg_am_pathogenicity,0) as x from ({NODES}) n) select node_id, round((x-(select avg(x) from n))/(select stddev_pop(x) from n),6)+0.0 as x from n")
def _(s, d):
    z = N.normalize(nodes(s, d).select("node_id", F.col("avg_am_pathogenicity").alias("x")), ["x"], "zscore")
    return z.select("node_id", (F.round("x", 6) + 0.0).alias("x"))


@query("linear_fit", f"""select 'mutability' as feature, count(*) as n, round(regr_slope(avg_am_pathogenicity, mutability),6)+0.0 as slope, round(regr_intercept(avg_am_pathogenicity, mutability),4) as intercept, round(corr(avg_am_pathogenicity, mutability),6)+0.0 as r from ({NODES}) n where avg_am_pathogenicity is not null
 union all select 'dssp_phi', count(*), round(regr_slope(avg_am_pathogenicity, dssp_phi),6)+0.0, round(regr_intercept(avg_am_pathogenicity, dssp_phi),4), round(corr(avg_am_pathogenicity, dssp_phi),6)+0.0 from ({NODES}) n where avg_am_pathogenicity is not null and dssp_phi is not null""")
def _(s, d):
    f = N.linear_fit(nodes(s, d), ["mutability", "dssp_phi"], "avg_am_pathogenicity")
    return f.select("feature", "n", (F.round("slope", 6) + 0.0).alias("slope"), F.round("intercept", 4).alias("intercept"), (F.round("r", 6) + 0.0).alias("r"))


@query("histogram", f"with n as materialized ({NODES}) select cast(least(floor((mutability-(select min(mutability) from n))/(((select max(mutability) from n)-(select min(mutability) from n))/20)),19) as int) as bin, count(*) as n from n group by 1")
def _(s, d):
    return N.histogram(nodes(s, d), "mutability", 20)


# --- encodings --------------------------------------------------------------------------------


@query("bin_equal_width", f"with n as materialized ({NODES}) select node_id, (select count(*) from range(1,42) t(i) where mutability > mn + i*((mx-mn)/42))::int as b from n, (select min(mutability) mn, max(mutability) mx from n) t")
def _(s, d):
    return EN.equal_width_bins(nodes(s, d), "mutability", "b").select("node_id", "b")


@query("bin_quantile", f"with n as materialized ({NODES}), q as (select unnest(quantile_cont(mutability, [{','.join(f'{i / 42:.17g}' for i in range(43))}])) as x from n), i as (select distinct x from q where x > (select min(mutability) from n) and x < (select max(mutability) from n)) select node_id, (select count(*) from i where i.x < n.mutability)::int as b from n")
def _(s, d):
    return EN.quantile_bins(nodes(s, d), "mutability", "b").select("node_id", "b")


@query("encode_modifications", f"select node_id, cast(case when coalesce(contains(ptms_mapped,'acet'),false) then 1 else 0 end as int) as ptm_acet, cast(case when coalesce(contains(ptms_mapped,'phos'),false) then 1 else 0 end as int) as ptm_phos, cast(case when ptms_mapped is null or ptms_mapped='[]' then 1 else 0 end as int) as ptm_is_na from ({NODES}) n")
def _(s, d):
    df, cols = EN.modification_columns(nodes(s, d).select("node_id", "ptms_mapped"))
    return df.select("node_id", *cols)


@query("encode_angles", f"select node_id, cast(case when dssp_phi is null then 1 else 0 end as int) as phi_is_na, round(coalesce(sin(radians(dssp_phi)),0),6)+0.0 as dssp_phi_sin, round(coalesce(cos(radians(dssp_phi)),0),6)+0.0 as dssp_phi_cos from ({NODES}) n")
def _(s, d):
    cols = EN.angular("dssp_phi")
    return nodes(s, d).select("node_id", *[(F.round(c, 6) + 0.0 if "is_na" not in k else c).alias(k) for k, c in cols.items()])


@query("encode_numeric_missing", f"select node_id, cast(case when avg_am_pathogenicity is null then 1 else 0 end as int) as kappa_is_na, round(coalesce(avg_am_pathogenicity,-1),6) as dssp_kappa from ({NODES}) n")
def _(s, d):
    n = nodes(s, d).select("node_id", F.col("avg_am_pathogenicity").alias("dssp_kappa"))
    return n.withColumns(EN.numeric_with_flag("dssp_kappa")).withColumn("dssp_kappa", F.round("dssp_kappa", 6)).select("node_id", "kappa_is_na", "dssp_kappa")


@query("encode_bend_chirality", f"select node_id, cast(case when dssp_sec_struct='H' then 1 else 0 end as int) as dssp_bend, cast(case when dssp_sec_struct='H' then 1 when dssp_sec_struct='E' then 2 else 0 end as int) as dssp_chirality from ({NODES}) n")
def _(s, d):
    n = nodes(s, d).select("node_id", F.when(F.col("dssp_sec_struct") == "H", "S").alias("dssp_bend"),
                           F.when(F.col("dssp_sec_struct") == "H", "-").when(F.col("dssp_sec_struct") == "E", "+").alias("dssp_chirality"))
    return n.select("node_id", EN.bend().alias("dssp_bend"), EN.chirality().alias("dssp_chirality"))


@query("scale_scores", f"""select node_id, round(coalesce(pow(10, avg_am_pathogenicity/10),0),6) as \"DAYM780301_avg\", round(coalesce(pow(2, avg_am_pathogenicity/3),0),6) as \"HENS920102_avg\",
 coalesce(case when total_mutations_count = 0 then null else total_mutations_count end, 0) as total_mutations_count, cast(case when total_mutations_count = 0 then 1 else 0 end as int) as mut_is_na from ({NODES}) n""")
def _(s, d):
    n = nodes(s, d).select("node_id", F.col("avg_am_pathogenicity").alias("DAYM780301_avg"), F.col("avg_am_pathogenicity").alias("HENS920102_avg"),
                           F.nullif("total_mutations_count", F.lit(0)).alias("total_mutations_count"))
    out = EN.scale_scores(n, ["DAYM780301_avg", "HENS920102_avg", "total_mutations_count"])
    return out.withColumns({c: F.round(c, 6) for c in ("DAYM780301_avg", "HENS920102_avg")})


@query("encode_labels", f"""with n as materialized ({NODES}), m as (select x, row_number() over (order by x) as i from (select distinct dssp_sec_struct as x from n where dssp_sec_struct is not null) t)
 select node_id, cast(coalesce(m.i,0) as int) as dssp_sec_struct from n left join m on m.x = n.dssp_sec_struct""")
def _(s, d):
    n = nodes(s, d).select("node_id", "dssp_sec_struct")
    return EN.apply_labels(n, "dssp_sec_struct", EN.fit_labels(n, "dssp_sec_struct"))


@query("assemble_features", f"""with n as materialized ({NODES}), m as (select x, row_number() over (order by x) as i from (select distinct dssp_sec_struct as x from n where dssp_sec_struct is not null) t)
 select node_id, round(mutability,4) as x0, cast(case when dssp_phi is null then 1 else 0 end as double) as x1, round(coalesce(sin(radians(dssp_phi)),0),6)+0.0 as x2, round(coalesce(cos(radians(dssp_phi)),0),6)+0.0 as x3, cast(coalesce(m.i,0) as int) as c0 from n left join m on m.x = n.dssp_sec_struct""")
def _(s, d):
    n = nodes(s, d)
    enc = EN.encode_features(n, ["mutability", "dssp_phi", "dssp_sec_struct"])
    x = EN.assemble(n.select("node_id", "mutability"), enc, graph_features=["mutability"])
    return x.select("node_id", F.round(F.col("x")[0], 4).alias("x0"), F.col("x")[1].alias("x1"), (F.round(F.col("x")[2], 6) + 0.0).alias("x2"),
                    (F.round(F.col("x")[3], 6) + 0.0).alias("x3"), F.col("x_cat")[0].alias("c0"))


@query("shuffle_feature_rows")
def _(s, d):
    return DS.shuffle_rows(nodes(s, d).select("node_id", "mutability"), "node_id", ["mutability"])


@query("batch_rows", f"select cast((row_number() over (order by node_id) - 1) // 256 as bigint) as batch_id, node_id from ({NODES}) n")
def _(s, d):
    return DS.batches(nodes(s, d).select("node_id"), 256, "node_id").select("batch_id", "node_id")
