"""Public medicinal-chemistry thresholds, weights and default parameters."""

# Drug-likeness rules.
LIPINSKI = {"MolWt": 500.0, "LogP": 5.0, "HBD": 5, "HBA": 10}
VEBER = {"TPSA": 140.0, "RotatableBonds": 10}
GHOSE = {"MolWt": (160.0, 480.0), "LogP": (-0.4, 5.6), "HeavyAtomCount": (20, 70), "MolMR": (40.0, 130.0)}
SANE_MOL_WT = (10.0, 5000.0)

# Bioactivity curation.
ACTIVITY_TYPES = ("IC50", "Ki", "Kd", "EC50")
NANOMOLAR = {"M": 1e9, "mM": 1e6, "uM": 1e3, "nM": 1.0, "pM": 1e-3}
EXACT_RELATIONS = ("=",)
PERMISSIVE_RELATIONS = ("=", "<", "<=")
IQR_MULTIPLIER = 1.5
ACTIVE_NM, INACTIVE_NM = 1000.0, 10000.0
CONFIDENCE = {"exact": 0.4, "pchembl": 0.3, "binding_assay": 0.2, "nanomolar": 0.1}
ACTIVITY_FIELDS = (
    "pchembl_value", "assay_chembl_id", "assay_description", "assay_type", "target_chembl_id", "document_chembl_id",
    "molecule_chembl_id", "standard_type", "standard_value", "standard_units", "standard_relation",
)
SMILES_COLUMNS = ("smiles", "SMILES", "Smiles", "canonical_smiles", "CANONICAL_SMILES", "smi", "SMI", "structure", "molecule", "mol")

# Scores.
COMPOSITE_WEIGHTS = {"predicted_activity": 0.4, "drug_likeness": 0.3, "sa_score_normalized": 0.3}
DRUG_LIKENESS_WEIGHTS = {"QED": 0.4, "lipinski_pass": 0.3, "pains_pass": 0.2, "veber_pass": 0.1}
CANDIDATE_RANGES = {"composite_score": (0.5, 1.0), "drug_likeness": (0.4, 1.0), "sa_score": (1.0, 6.0)}
SA_RANGE = (1.0, 10.0)

# ADMET rules.
ADMET_WEIGHTS = {"absorption": 0.25, "distribution": 0.15, "metabolism": 0.20, "excretion": 0.10, "toxicity": 0.30}
ADMET_FAVORABLE, ADMET_MODERATE = 0.7, 0.4
CYP_ALERTS = {
    "imidazole": "[nR1]1cc[nR1]c1", "triazole": "[nR1]1c[nR1][nR1]c1", "pyridine_N": "c1ccncc1", "thiophene": "c1ccsc1", "furan": "c1ccoc1",
    "methylenedioxy": "O1COc2ccccc21", "thioamide": "C(=S)N", "hydrazine": "[NH]N", "isothiocyanate": "N=C=S",
}
HERG_ALERTS = {"basic_nitrogen_long_chain": "[NH2,NH1,NH0]CCCC", "phenothiazine": "c1ccc2c(c1)Sc1ccccc1N2", "diphenylmethyl": "C(c1ccccc1)c1ccccc1"}
AMES_ALERTS = {
    "aromatic_nitro": "c[N+](=O)[O-]", "aromatic_amine": "c[NH2]", "aromatic_nitroso": "cN=O", "epoxide": "C1OC1", "aziridine": "C1NC1", "alkyl_halide": "[CX4][Cl,Br,I]",
    "michael_acceptor": "[CH]=[CH]C(=O)", "aldehyde": "[CH1](=O)", "acyl_halide": "C(=O)[Cl,Br,I]", "nitrogen_mustard": "ClCCN", "hydrazine_ames": "[NH2][NH2]", "azide": "[N-]=[N+]=N",
}
HEPATOTOX_ALERTS = {
    "quinone": "O=C1C=CC(=O)C=C1", "thiophene_hep": "c1ccsc1", "furan_hep": "c1ccoc1", "aniline": "c1ccc(N)cc1", "nitroaromatic_hep": "c[N+](=O)[O-]",
    "hydrazine_hep": "[NH]N", "michael_acceptor_hep": "[CH]=[CH]C(=O)", "epoxide_hep": "C1OC1", "acyl_glucuronide": "OC(=O)c",
}

# Three-dimensional contacts (angstroms) and docking boxes.
HBOND_DISTANCE, HYDROPHOBIC_DISTANCE, PI_DISTANCE, SALT_DISTANCE = 3.5, 4.5, 5.5, 4.0
DONOR_ELEMENTS, ACCEPTOR_ELEMENTS = ("N", "O"), ("N", "O", "F", "S")
BOX_PADDING, BOX_SIDES = 10.0, (5.0, 200.0)
WATERS = ("HOH", "WAT", "H2O", "DOD")
RESIDUES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")

# Generation.
R_GROUPS = ("C", "CC", "C(C)C", "O", "N", "F", "Cl", "Br", "OC", "C(F)(F)F", "C(=O)O", "C(=O)N", "C#N", "S(=O)(=O)N", "c1ccccc1", "C1CC1", "C(=O)", "S", "OCC", "NC")
SWAP_ELEMENTS = ("C", "N", "O", "F", "S", "Cl")
MUTATIONS = ("atom_swap", "bond_change", "add_fragment", "remove_fragment", "ring_mutation")
PHARMACOPHORE_FAMILIES = ("Donor", "Acceptor", "NegIonizable", "PosIonizable", "Aromatic", "Hydrophobe", "LumpedHydrophobe")
