"""Table schemas and fixed values of the trajectory data model."""

from __future__ import annotations

ATOMS = "system_id int, atom_idx int, atom_name string, element string, residue_id int, residue_name string, mass float, charge float"
BONDS = "system_id int, i int, j int"
#: One row for each frame: box is null or 9 numbers (cell vectors as rows), xyz has 3 numbers an atom.
FRAMES = "system_id int, frame_id bigint, time_ps double, box array<double>, xyz array<float>"
COORDS = "system_id int, frame_id bigint, atom_idx int, x double, y double, z double"

# Residue names of proteins, atom names of the backbone.
PROTEIN = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "HIE", "HID", "HIP", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "SEC", "PYL", "ASH", "GLH", "CYM", "CYX", "LYN")
BACKBONE = ("N", "CA", "C", "O", "HA", "H")
# Residue labels of solvents and ions (compared trimmed, in capitals).
SOLVENTS = ("WAT", "HOH", "SOL", "TIP", "TIP3", "TIP4", "TIP5", "TP3", "TP4", "SPC", "SPCE", "T3P", "T4P", "T5P", "OPC", "OPC3", "OPC4")
IONS = ("NA", "CL", "K", "MG", "ZN", "CA", "FE", "CU", "MN", "CO", "NA+", "CL-", "K+", "MG2+", "CA2+", "ZN2+", "FE2+", "FE3+", "RB", "CS", "BR", "I", "POT", "SOD", "CLA", "CES", "RUB", "CIO")
# Van der Waals radii by element (exact case), and the radius of any other.
VDW_RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "P": 1.80, "S": 1.80, "Cl": 1.75, "Br": 1.85, "I": 1.98, "Na": 2.27, "Mg": 1.73, "K": 2.75, "Ca": 2.31, "Zn": 1.39, "Fe": 1.94}
VDW_DEFAULT = 1.70
# Elements by atomic number.
ELEMENTS = {1: "H", 2: "He", 3: "Li", 4: "Be", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 10: "Ne", 11: "Na", 12: "Mg", 13: "Al", 14: "Si", 15: "P", 16: "S", 17: "Cl", 18: "Ar", 19: "K", 20: "Ca", 24: "Cr", 25: "Mn", 26: "Fe", 27: "Co", 28: "Ni", 29: "Cu", 30: "Zn", 35: "Br", 53: "I"}
#: Charges of AMBER topologies are stored times this.
AMBER_CHARGE = 18.2223
