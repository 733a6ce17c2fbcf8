"""Network assessment analytics on Spark: scan documents and device output in, inventory, topology, audits and findings out."""
