"""Alphabets, the genetic code, motif and signature tables, residue scales."""

DNA, RNA, AMINO = "ATCG", "AUCG", "ACDEFGHIKLMNPQRSTVWY"
IUPAC = "ATCGURYSWKMBDHVN-"

# The standard genetic code: one residue for each codon, bases in the order T, C, A, G.
BASES = "TCAG"
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")

COMPLEMENT = ("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")

# Motif scans: family, name, pattern, length, score.
MOTIFS = (
    ("promoter", "TATA_BOX", "TATAAA", 6, 0.0),
    ("promoter", "CAAT_BOX", "CCAAT", 5, 0.0),
    ("promoter", "GC_BOX", "GGGCGG", 6, 0.0),
    ("enhancer", "AP1_SITE", "TGACTCA", 7, 0.7),
    ("enhancer", "NFKB_SITE", "GGGACTTTCC", 10, 0.7),
    ("enhancer", "SP1_SITE", "GGGCGG", 6, 0.7),
    ("tf_site", "P53", "[AG][AG][AG]C[AT][AT]G[CT][CT][CT]", 10, 0.6),
    ("tf_site", "MYC", "CACGTG", 6, 0.6),
    ("tf_site", "ETS", "GGAA", 4, 0.6),
    ("splice_donor", "GT", "GT", 2, 0.0),
    ("splice_donor", "GC", "GC", 2, 0.0),
    ("splice_acceptor", "AG", "AG", 2, 0.0),
)
ONCOGENIC = (
    ("oncogenic", "p53_binding", "[AG][AG][AG]C[AT][AT]G[CT][CT][CT]", 10, 0.8),
    ("oncogenic", "myc_binding", "CACGTG", 6, 0.6),
    ("oncogenic", "ras_mutation", "GGTGGC", 6, 0.6),
)

BACTERIAL = (("RIBOSOMAL_16S", "ACCTGGTTGATCCTGCCAG"), ("BACTERIAL_PROMOTER", "TTGACA"), ("SHINE_DALGARNO", "AGGAGG"))
BACTERIAL_LOOSE = (
    ("RIBOSOMAL_PARTIAL", ("ACCTGG", "GATCCT", "TGCCAG")),
    ("PROMOTER_LIKE", ("TTGAC", "TGACA", "GACAA")),
    ("RBS_LIKE", ("AGGAG", "GGAGG", "GAGG")),
)
VIRAL = (("VIRAL_POLYMERASE", "YGDD"), ("VIRAL_CAPSID", "GPNG"), ("PACKAGING_SIGNAL", "AATAAA"))
RESISTANCE = (
    ("BETA_LACTAMASE", "SXXK", "beta_lactams"),
    ("AMINOGLYCOSIDE", "APH", "aminoglycosides"),
    ("TETRACYCLINE", "TETM", "tetracyclines"),
)
VIRULENCE = (("ADHESIN", "RGDS"), ("TOXIN", "ADPRT"), ("INVASION", "INVASIN"))
ENZYME = (("SERINE_PROTEASE", "HDS"), ("KINASE_DOMAIN", "DFG"), ("ZINC_FINGER", "CxxC"))
ENZYME_LOOSE = (
    ("CATALYTIC_TRIAD", ("HD", "DS", "HG")),
    ("METAL_BINDING", ("CC", "HH", "CG")),
    ("ATP_BINDING", ("GK", "MG", "DG")),
)

DISEASE_WORDS = (
    "cancer", "tumor", "disease", "affected", "diseased", "mutant", "mutation", "pathogenic", "malignant", "positive",
)
NORMAL_WORDS = ("normal", "healthy", "control", "wildtype", "wild-type", "benign", "negative", "unaffected")

KYTE_DOOLITTLE = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
RESIDUE_WEIGHTS = {
    "A": 89, "C": 121, "D": 133, "E": 147, "F": 165, "G": 75, "H": 155, "I": 131, "K": 146, "L": 131,
    "M": 149, "N": 132, "P": 115, "Q": 146, "R": 174, "S": 105, "T": 119, "V": 117, "W": 204, "Y": 181,
}

# Average masses of the residues as free amino acids, and of water.
RESIDUE_MASSES = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729, "K": 146.1876, "L": 131.1729,
    "M": 149.2113, "N": 132.1179, "P": 115.1305, "Q": 146.1445, "R": 174.201, "S": 105.0926, "T": 119.1192, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
WATER_MASS = 18.0153

# pK values of side chains and ends (Bjellqvist), ends by residue where they differ, and the bounds of the search.
POSITIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_END_PK, C_END_PK = 7.5, 3.55
N_END_PK_OF = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_END_PK_OF = {"D": 4.55, "E": 4.75}
PH_START, PH_LOW, PH_HIGH = 7.775, 4.05, 12.0

# Literals that the scores of pathogens and drug targets look for.
VIRULENCE_WORDS = ("TTSS", "INVASIN", "TOXIN", "ADHESIN")
RESISTANCE_WORDS = ("BLACTAM", "AMINOGLY", "TETRACYC", "VANCOMYC")
PHYLOGENETIC_WORDS = ("ACCTGGTTGATCCTGCCAG", "TTGACA", "TATAAT")
HOST_WORDS = ("RGD", "NPXY", "YXXL")
BINDING_WORDS = ("ATP", "GTP", "NAD", "FAD", "KINASE", "DOMAIN")

FEATURE_PAIRS = ("AT", "TA", "CG", "GC")
AMBIGUOUS_BASES, AMBIGUOUS_RESIDUES = "NRYSWKMBDHV", "XBZJ"
