"""haplomill: haplotype analytics and corpus preparation as PySpark plans."""
