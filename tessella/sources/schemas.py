"""Declared schemas of the input tables."""

from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructType

CONTACT_EDGES = (
    StructType()
    .add("uniprot1", StringType())
    .add("pdb_auth_resi1", IntegerType())
    .add("res3n1", StringType())
    .add("uniprot2", StringType())
    .add("pdb_auth_resi2", IntegerType())
    .add("res3n2", StringType())
    .add("pdb_code", StringType())
    .add("chain_flag", StringType())
    .add("coulombs_energy", DoubleType())
    .add("lj_energy", DoubleType())
    .add("total_energy", DoubleType())
    .add("cleaned_lj_energy", DoubleType())
    .add("cleaned_total_energy", DoubleType())
)
EXCLUDED_STRUCTURES = StructType().add("0", StringType())
INCLUDED_PROTEINS = StructType().add("uniprot", StringType())
CODON_CONTEXTS = (
    StructType()
    .add("node_id", StringType())
    .add("ensmbl_id", StringType())
    .add("cds_contexts", StringType())
    .add("unique_cds_contexts", StringType())
)
COSMIC = (
    StructType()
    .add("Accession Number", StringType())
    .add("FATHMM score", DoubleType())
    .add("Mutation CDS", StringType())
)
MUTAGENE = (
    StructType()
    .add("label", StringType())
    .add("Transcript ID", StringType())
    .add("mutation", StringType())
    .add("Protein ID", StringType())
    .add("PubMed Id", StringType())
    .add("Swissprot ID", StringType())
)
CHASMPLUS = (
    StructType()
    .add("Transcript ID", StringType())
    .add("gwCHASMplus score", DoubleType())
    .add("mutation", StringType())
    .add("Novel", StringType())
)
SUBSTITUTION_MODEL = MapType(StringType(), MapType(StringType(), DoubleType()))
