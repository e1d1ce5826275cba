"""A small molecule kernel in plain Python: SMILES in, atoms, rings, properties, patterns and fingerprints out.

It is called from Arrow UDFs only. It covers what SMILES and a practical part of SMARTS need;
properties that rest on large published parameter tables (LogP, TPSA, QED, synthetic accessibility)
are read as input columns and never estimated here.
"""
